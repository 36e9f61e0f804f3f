"""N-gram join, repeated passages, vectors, components."""

import hashlib
import random
import zlib


import numpy as np
import pytest
from corpus import FOLDER, Classes, awkward, frame, in_order, jaccard_classes, rows_of, sentence, words
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talusgrid.llm import graphs, ngram_join, substrings, vectors
from talusgrid.llm.queries import llm_queries


def edited(text, seed, times):
    pick, w = random.Random(seed), text.split()
    for _ in range(times):
        w[pick.randrange(len(w))] = f"edit{pick.randrange(10**6)}"
    return " ".join(w)


def near_copies():
    """A large group of near copies, chains of them, and texts that only share a passage."""
    base, passage, rows = sentence(500, 120), sentence(501, 40), []
    rows += [(100 + i, edited(base, i, i % 4), "en", "a") for i in range(60)]
    text = sentence(502, 150)
    for i in range(30):
        rows.append((200 + i, text, "en", "b"))
        text = edited(text, 1000 + i, 2)
    rows += [(300 + i, f"{sentence(600 + i, 60)} {passage} {sentence(800 + i, 60)}", "en", "c") for i in range(40)]
    rows += [(400 + i, base.upper() if i % 2 else base, "en", "c") for i in range(20)]
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_classes(spark, n, percent):
    docs = awkward(spark, near_copies())
    got = rows_of(ngram_join.ngram_classes(docs, n, percent), "doc_id", "n_shingles", "component_id")
    assert got == in_order(jaccard_classes([(r.doc_id, r.text) for r in docs.collect()], n, percent))


def test_ngram_classes_in_many_blocks(spark, monkeypatch):
    """Clusters cut into small blocks, and columns that link whole groups, give the same classes."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "DENSE", 2)
    docs = awkward(spark, near_copies()).repartition(3)
    got = rows_of(ngram_join.ngram_classes(docs, 3, 90), "doc_id", "n_shingles", "component_id")
    assert got == in_order(jaccard_classes([(r.doc_id, r.text) for r in docs.collect()], 3, 90))


def candidates(docs, n, percent, noise=0):
    """Sizes of the clusters of candidates, largest first; noise: what a far larger corpus adds to each cell of the column table, about."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", F.lit(0).cast("long").alias("text_hash"))
    schema = "doc_id long, text_hash long, n_shingles long, digest binary, node long, slice int, counts binary"
    described = texts.mapInArrow(ngram_join._describe(n), schema)
    if noise:
        cells = [np.random.default_rng(k).poisson(noise, ngram_join.CELLS // ngram_join.SLICES).astype(np.uint16) for k in range(ngram_join.SLICES)]
        rows = [(None, None, None, None, None, k, bytearray(zlib.compress(part.tobytes(), 1))) for k, part in enumerate(cells)]
        described = described.unionByName(spark.createDataFrame(rows, schema))
    found = ngram_join._clusters(texts.drop("text_hash"), described.cache(), n, percent)
    return sorted((r["count"] for r in found.groupBy("component").count().collect()), reverse=True)


def test_copies_of_a_row_count_once_in_a_column(spark):
    """Ten copies of each text in as many tasks do not make a word of two texts a frequent one, which would link them all."""
    rows = [(100 * i + k, f"x{i} x{i + 1} u{i} v{i}") for i in range(12) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(10, F.col("doc_id") % 10)
    assert candidates(docs, 1, 50) == []


def test_a_full_column_table_leaves_rare_columns_first(spark):
    """Where the table of column counts is all noise, texts that share common phrases alone are no candidates."""
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choice("abcdefgh") if pick.random() < 0.7 else f"w{pick.randrange(10**6)}" for _ in range(150))) for i in range(400)]
    rows += [(1000 + i, edited(rows[i][1], i, 2)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert candidates(docs, 3, 80, noise=1000) == [2] * 5


def test_ngram_classes_of_many_sizes(spark, monkeypatch):
    """One cluster whose sets differ in size, cut into blocks by size; some links are at the bound, and some lengths are missing."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ngram_join, "FEW", 3)
    text = sentence(77, 600).split()
    sizes = [*range(10, 30), 38, 39, 48, 60, 61, 75, 76, *range(100, 130, 3), 163, 204, 205, 500, 400, 320, 256]
    docs = spark.createDataFrame([(i, " ".join(text[:size])) for i, size in enumerate(sizes)], "doc_id long, text string").repartition(3)
    for percent in (80, 100):
        got = rows_of(ngram_join.ngram_classes(docs, 1, percent), "doc_id", "n_shingles", "component_id")
        assert got == in_order(jaccard_classes([(r.doc_id, r.text) for r in docs.collect()], 1, percent))


def test_ngram_query(spark):
    rows = list(frame(spark, "documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    got = rows_of(llm_queries()["op9_ngram_join"](spark, FOLDER), "doc_id", "n_shingles", "component_id")
    assert got == in_order(jaccard_classes(rows, 3, 90))


def test_deduplicated_keeps_one_of_each_group(spark):
    docs = awkward(spark, near_copies())
    kept = ngram_join.deduplicated(docs, 3, 90)
    assert kept.schema == docs.schema
    named = [(d, t) for d, t in docs.select("doc_id", "text").collect() if d is not None]
    want = sorted({c for d, _, c in jaccard_classes([(r.doc_id, r.text) for r in docs.collect()], 3, 90) if d == c and d is not None})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want and named
    assert kept.where("doc_id is null").count() == 2
    assert ngram_join.deduplicated(awkward(spark, empty=True)).count() == 0


def kept_by_force(rows, span):
    """(doc, text) -> removed positions, by comparing all windows."""
    first, order = {}, sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    gone = {}
    for doc, text in order:
        w, cover = words(text), set()
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            if key in first:
                cover |= set(range(i, i + span))
            else:
                first[key] = (doc, i)
        gone[doc, text] = cover
    return gone


def passages():
    passage, period = sentence(900, 33), "x y z"
    rows = [(500 + i, f"{sentence(910 + i, 25)}\n{passage} {sentence(950 + i, 25)}", "en", "a") for i in range(30)]
    rows += [(600, " ".join([period] * 30), "en", "a"), (601, " ".join(["w"] * 45), "en", "a"), (602, " ".join(["w"] * 20), "en", "a")]
    rows += [(603, sentence(990, 20), "en", "a"), (604, sentence(990, 20), "en", "a"), (605, sentence(990, 19), "en", "a"), (606, sentence(990, 20).upper(), "en", "a")]
    return rows


@pytest.mark.parametrize("span", [20, 9])
def test_repeats(spark, span):
    docs = awkward(spark, passages()).repartition(4)
    gone = kept_by_force([(r.doc_id, r.text) for r in docs.collect()], span)
    want = []
    for r in docs.collect():
        w = words(r.text)
        kept = [x for i, x in enumerate(w) if i not in gone[r.doc_id, r.text]]
        want.append((r.doc_id, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert rows_of(substrings.repeat_counts(docs, span), "doc_id", "n_words", "n_removed", "kept_sha256") == in_order(want)


def test_repeats_with_a_full_sketch(spark, monkeypatch):
    """Where every cell is taken, the result stays the same."""
    full = np.full(substrings.SKETCH_CELLS // 8, 255, dtype=np.uint8)
    docs = awkward(spark, passages())
    want = rows_of(substrings.repeat_counts(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    monkeypatch.setattr(substrings, "repeated_bits", lambda *a: full)
    assert rows_of(substrings.repeat_counts(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_repeats_are_cut_from_texts(spark):
    docs = awkward(spark, passages())
    out = substrings.without_repeats(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[602] == "" and got[603] == sentence(990, 20) and got[604] == "" and got[606] == sentence(990, 20).upper()
    assert got[2] is None and got[4] == " \t\n\x0b\x0c\r "
    assert substrings.without_repeats(awkward(spark, empty=True)).count() == 0


VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType())]
)


def vector_rows(seed=0):
    """Near copies of a few centres, exact copies, scaled copies, other labels, and unusable vectors."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, 64))
    rows = [(i, (centres[i % 12] + r.standard_normal(64) * r.choice([0.05, 0.25, 0.3, 0.4])).tolist(), int(i % 2)) for i in range(400)]
    rows += [(1000 + i, centres[0].tolist(), 0) for i in range(50)] + [(1100 + i, (centres[0] * 3).tolist(), 0) for i in range(5)]
    bad = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0] * 3]
    rows += [(1200 + i, v, 0) for i, v in enumerate(bad)] + [(1300, centres[0].tolist(), None), (None, centres[0].tolist(), 0), (7, rows[7][1], rows[7][2])]
    return [(i, v, label, "x") for i, v, label in rows]


def links_by_force(rows):
    good = [i for i, r in enumerate(rows) if r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    classes, links = Classes(len(rows)), [0] * len(rows)
    for k, i in enumerate(good):
        x = np.array(rows[i].embedding, dtype=float)
        for j in good[:k]:
            y = np.array(rows[j].embedding, dtype=float)
            if rows[i].label == rows[j].label and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1
                links[j] += 1
                classes.join(i, j)
    low = {}
    for i, r in enumerate(rows):
        if r.vec_id is not None:
            low[classes.find(i)] = min(low.get(classes.find(i), r.vec_id), r.vec_id)
    return [(r.vec_id, links[i], low.get(classes.find(i), r.vec_id)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 40])
def test_vectors(spark, block):
    table = spark.createDataFrame(vector_rows(), VECTORS)
    got = rows_of(vectors.near_duplicates(table, block=block), "vec_id", "n_links", "component_id")
    assert got == in_order(links_by_force(table.collect()))


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_collisions_reach_nearly_all_pairs_at_the_threshold():
    """Recall at the threshold itself, where it is lowest."""
    r = np.random.default_rng(5)
    one = r.standard_normal((400, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side = r.standard_normal((400, 64))
    side -= (side * one).sum(axis=1, keepdims=True) * one
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    two = 0.9301 * one + np.sqrt(1 - 0.9301**2) * side
    found = vectors.linked(one, two, 0.93, False)
    assert found.diagonal().mean() == 1.0
    assert vectors.needed_collisions(64, 0.6827, 1e-6) > 20


def test_components(spark):
    pick = random.Random(3)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5, 5)]
    classes = Classes(1200)
    for a, b in edges:
        classes.join(a, b)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = rows_of(graphs.components(spark.createDataFrame(edges, "a long, b long")), "node", "component")
    assert got == sorted((x, classes.find(x)) for x in touched)
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicated_loses_no_text(spark):
    """Rows with one doc_id and different texts both stay; copies of any id, null ones too, go; which row stays does not depend on order."""
    text = [sentence(9000 + k, 60) for k in range(4)]
    rows = [(900, text[0], "en", "a"), (900, text[1], "en", "a"), (900, text[1], "en", "a"), (901, text[1] + " more", "en", "a")]
    rows += [(None, text[2], "en", "a"), (None, text[2], "en", "a"), (902, text[3], "en", "a"), (None, text[3], "en", "a"), (None, None, "en", "a"), (None, None, "en", "a")]
    docs = spark.createDataFrame([(i, t, lang, s) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string")
    want = sorted([(900, text[0]), (900, text[1]), (902, text[3])])
    for dealt in (docs, docs.repartition(5), docs.orderBy(F.desc("text"))):
        kept = [(r.doc_id, r.text) for r in ngram_join.deduplicated(dealt).collect()]
        assert sorted(k for k in kept if k[0] is not None) == want
        assert sorted(str(t) for d, t in kept if d is None) == sorted(["None", "None", text[2]])
