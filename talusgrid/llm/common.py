"""Words, keys and stored intermediate tables, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.sources.workspace import new_table_path

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

ROW = "__row"

BATCH_ROWS = 2500
BATCH_BYTES = 8 << 20


def word_count(text: Column) -> Column:
    """Number of words; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """All words in order; an empty array for null and empty texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most BATCH_ROWS rows and BATCH_BYTES, as texts can be long and tasks hold whole batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the cluster's shared work folder and read it back.

    Cuts the lineage, survives lost executors and keeps later scans narrow.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> Column:
    """The whole input row as one struct, so that no input column can clash with a computed one."""
    return F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]).alias(ROW)
