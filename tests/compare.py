"""Run queries and their SQL side by side and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def session(cores: str = "8") -> SparkSession:
    if os.environ.get("PLAIN_SESSION"):
        return SparkSession.builder.master(f"local[{cores}]").getOrCreate()
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="talusgrid-tests-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="last", kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if equal, else a short reason. Values are compared exactly."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y):
            x, y = x.astype(float), y.astype(float)
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = same.idxmin()
            return f"column {c}: {int((~same).sum())} of {len(a)} differ, e.g. {dict(a.loc[i])} vs {dict(b.loc[i])}"
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    folder = sys.argv[1]
    names = sys.argv[2:]
    queries, sql = e.queries(), e.oracle_sql()
    spark, con = session(), connect(folder)
    bad = 0
    for name in names or queries:
        t0 = time.time()
        try:
            df = queries[name](spark, folder)
            got = df.toPandas()
            t1 = time.time()
            if name not in sql:
                print(f"ROWS {name} {len(got)}")
                continue
            want = con.execute(sql[name]).fetchdf()
            why = difference(got, want)
            t2 = time.time()
            types = [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema]
            print(f"{'ok  ' if why is None else 'DIFF'} {name} rows={len(got)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s", why or "", flush=True)
            if why:
                print("   ", types, flush=True)
            bad += why is not None
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} {type(ex).__name__}: {str(ex)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
