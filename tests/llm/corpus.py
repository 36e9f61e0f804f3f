"""Small tables with all the awkward cases, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Columns whose names the operators use themselves.
        T.StructField("size", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("__row", T.StringType()),
        T.StructField("a.b", T.StringType()),
    ]
)


def sentence(seed: int, n: int) -> str:
    """n words that look like words and differ by seed."""
    out = []
    for k in range(n):
        h = hashlib.md5(f"{seed}/{k}".encode()).digest()
        out.append("".join("abcdefghijklmnoprstuvw"[b % 22] for b in h[: 2 + h[0] % 6]))
    return " ".join(out)


def awkward(spark, more: list[tuple] = (), empty: bool = False):
    """Documents with nulls, empty, blank, short, long, equal and repeated texts; `more` adds (doc_id, text, lang, source)."""
    long = sentence(7, 6000)
    rows = [
        (1, sentence(1, 80), "en", "a"),
        (2, None, "en", "a"),
        (3, "", "en", "b"),
        (4, " \t\n\x0b\x0c\r ", None, "b"),
        (5, "one", "en", None),
        (6, "one two", None, None),
        (7, sentence(1, 80), "en", "a"),
        (7, sentence(1, 80), "en", "a"),
        (None, sentence(2, 60), "fr", "c"),
        (None, None, None, None),
        (8, long, "de", "a"),
        (9, long + " " + sentence(8, 10), "de", "c"),
        (10, "a▁b  \U0001f600 éßİ " + sentence(3, 70), "fr", "b"),
        *more,
    ]
    full = [(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "w", "v") for i, t, lang, s in rows]
    return spark.createDataFrame([] if empty else full, SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    if len(found) >= n:
        return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}
    return {tuple(found)} if found else set()


class Classes:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def jaccard_classes(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    """(doc_id, text) rows -> (doc_id, n_shingles, component_id) by comparing all rows that share an n-gram."""
    sets = [shingles(t, n) for _, t in rows]
    by_gram = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by_gram[g].append(i)
    shared: dict[tuple[int, int], int] = defaultdict(int)
    for group in by_gram.values():
        for k, i in enumerate(group):
            for j in group[:k]:
                shared[i, j] += 1
    classes = Classes(len(rows))
    for (i, j), count in shared.items():
        if 100 * count >= percent * (len(sets[i]) + len(sets[j]) - count):
            classes.join(i, j)
    low: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            c = classes.find(i)
            low[c] = min(low.get(c, doc), doc)
    return [(doc, len(sets[i]), low.get(classes.find(i), doc) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def rows_of(df, *columns: str) -> list[tuple]:
    """Rows in a fixed order, nulls first."""
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: [(x is not None, x) for x in r])


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def frame(spark, name: str, folder: str = FOLDER) -> pd.DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").toPandas()
