"""Ranked lexical search with hashed max-sketches.

A term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); in a document with n terms it has the impact
(10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L. A document's score for an item is the sum of w * impact over
the item's terms.

1. One pass counts N, L and the document frequencies of the items' terms, added up per task.
2. A second pass folds all impacts of a document into a sketch of `CELLS` coordinates, each the maximum over the terms
   that hash to it. An item's terms looked up in the sketch and multiplied by their weights bound its score from above;
   for a batch of documents and all items of a block that is one matrix product, exact in doubles as all numbers are
   whole and below 2^53.
3. Per item, documents are rescored exactly in descending order of their bounds until the next bound is below the score
   of the last place. The places of a task carry over from batch to batch, so later batches rescore less. Tasks send their
   places, and the best of those are the answer: first by item and a hash of the document, then by item.

Items are taken in blocks by hash, of about `ITEMS` items and `TERMS` terms, each with its own passes, as a block's terms and weights
are broadcast. Documents are never shuffled. Terms are compared by 64-bit hashes.

Cases. Null and empty texts have no terms. Rows that repeat an item_id, null included, are one item with the terms of all
its texts. Repeated documents are ranked each on its own; equal scores go by doc_id, nulls last. Empty tables give
an empty result. Very long texts are handled whole. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from talusgrid.llm import hashing
from talusgrid.llm.common import small_batches, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[:128] = True
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    BETWEEN[_low:_high] = False
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PLACES = 50
CELLS = 1024
ITEMS = 1024
TERMS = 1 << 19
#: Documents of an item that are rescored at a time.
STEP = 64
SALTS = 64
SEED = 21


def document_terms(texts: pa.Array):
    """(terms with repeats per row, hashes of the piece's different terms, row, term number and tf of each entry) of consecutive rows."""
    for _, data, at in hashing.pieces(texts):
        data, rows = hashing.LOWER[data], len(at) - 1
        start, end, row = hashing.words(data, at, BETWEEN)
        if not len(start):
            none = np.zeros(0, dtype=np.int64)
            yield np.zeros(rows, dtype=np.int64), none.view(np.uint64), none, none, none
            continue
        terms, which = np.unique(hashing.word_hashes(data, start, end, SEED), return_inverse=True)
        entry, tf = np.unique(row * len(terms) + which, return_counts=True)
        yield np.bincount(row, minlength=rows), terms, entry // len(terms), entry % len(terms), tf


def places_of(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Index of each value in an ordered array, -1 where it is missing."""
    if not len(ordered):
        return np.full(len(values), -1, dtype=np.int64)
    spot = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[spot] == values, spot, -1)


def _tallied(vocabulary: Broadcast):
    """Per task (term number, documents); term -1 has the documents with terms, -2 all terms."""

    def run(batches):
        known = vocabulary.value
        seen = np.zeros(len(known) + 2, dtype=np.int64)  # the last two are -2 and -1
        for batch in batches:
            for sizes, terms, _, which, _ in document_terms(batch.column("text")):
                spot = places_of(terms, known)[which]
                seen += np.bincount(spot[spot >= 0], minlength=len(seen))
                seen[-1] += np.count_nonzero(sizes)
                seen[-2] += sizes.sum()
        some = np.flatnonzero(seen)
        names = np.where(some >= len(known), some - len(seen), some)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(seen[some])], names=["term", "times"])

    return run


class Block:
    """Items with their terms: hashes of all terms in order, and per item the numbers of its terms. Counts make weights of them."""

    def __init__(self, rows: pa.Table):
        names, items = np.unique(rows.column("item").to_numpy(), return_inverse=True)
        terms = rows.column("term").combine_chunks().cast(pa.string())
        hashes = [hashing.word_hashes(data, at[:-1], at[1:], SEED) for _, data, at in hashing.pieces(terms)]
        self.terms, which = np.unique(np.concatenate(hashes), return_inverse=True)
        order = np.argsort(items, kind="stable")
        self.names, self.owner, self.member = names, items[order], which[order]
        self.edges = np.searchsorted(self.owner, np.arange(len(names) + 1))

    def weigh(self, counts: dict[int, int], cells: int) -> None:
        self.documents, self.total = counts.get(-1, 0), counts.get(-2, 0)
        top = 2 * self.documents + 2
        self.weight = np.array([math.floor(1000 * math.log(top / (2 * counts.get(t, 0) + 1))) for t in range(len(self.terms))], dtype=np.int64)
        self.matrix = np.zeros((cells, len(self.names)))
        np.add.at(self.matrix, ((self.terms % np.uint64(cells)).astype(np.int64)[self.member], self.owner), self.weight[self.member])


class Places:
    """The best documents of one item so far, highest score first; equal scores by doc_id, nulls last."""

    def __init__(self, size: int):
        self.size, self.score, self.doc, self.null = size, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def needed(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.size else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.needed
        score, doc, null = (np.concatenate(x) for x in ((self.score, score[good]), (self.doc, doc[good]), (self.null, null[good])))
        best = np.lexsort((doc, null, -score))[: self.size]
        self.score, self.doc, self.null = score[best], doc[best], null[best]


def sketches(rows: int, row: np.ndarray, terms: np.ndarray, impact: np.ndarray, cells: int) -> np.ndarray:
    """Per row and cell, the largest impact of a term that falls into it."""
    out = np.zeros(rows * cells)
    np.maximum.at(out, row * cells + (terms % np.uint64(cells)).astype(np.int64), impact)
    return out.reshape(rows, cells)


def _best(block: Broadcast, size: int, cells: int, step: int):
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        items: Block = block.value
        places, vocabulary = [Places(size) for _ in items.names], len(items.terms)
        for batch in batches:
            bounds, keys, values, base = [], [], [], 0
            for sizes, terms, row, which, tf in document_terms(batch.column("text")):
                m = 50 + (50 * sizes * items.documents) // items.total
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
                bounds.append(sketches(len(sizes), row, terms[which], impact, cells) @ items.matrix)
                spot = places_of(terms, items.terms)[which]
                keys.append((row + base)[spot >= 0] * vocabulary + spot[spot >= 0])
                values.append(impact[spot >= 0])
                base += len(sizes)
            if not base:
                continue
            bound, key, value = np.concatenate(bounds), np.concatenate(keys), np.append(np.concatenate(values), 0)
            doc, null = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for i, best in enumerate(places):
                rows = np.flatnonzero(bound[:, i] >= best.needed)
                rows = rows[np.argsort(-bound[rows, i], kind="stable")]
                member = items.member[items.edges[i] : items.edges[i + 1]]
                for k in range(0, len(rows), step):
                    part = rows[k : k + step]
                    if bound[part[0], i] < best.needed:
                        break
                    spot = places_of((part[:, None] * vocabulary + member).reshape(-1), key)
                    exact = (value[spot].reshape(len(part), -1) * items.weight[member]).sum(axis=1)
                    best.add(exact, doc[part], null[part])
        for i, best in enumerate(places):
            if len(best.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best.score), items.names[i], dtype=np.int32)), pa.array(best.doc, mask=best.null), pa.array(best.score)], schema=schema
                )

    return run


def _searched(texts: DataFrame, rows: pa.Table, places: int, cells: int, step: int) -> DataFrame:
    """(item, doc_id, score): every task's places of the items of one block."""
    context = texts.sparkSession.sparkContext
    block = Block(rows)
    tally = texts.select("text").mapInArrow(_tallied(context.broadcast(block.terms)), "term long, times long")
    # A number per term of the block at most.
    block.weigh({r.term: r.times for r in tally.groupBy("term").agg(F.sum("times").alias("times")).collect()}, cells)
    return texts.mapInArrow(_best(context.broadcast(block), places, cells, step), "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, places: int = PLACES, cells: int = CELLS, items_a_block: int = ITEMS, step: int = STEP) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (item_id, rank, doc_id, score): the `places` best documents of each item."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    split = F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))))
    wanted = stored(items.select("item_id", split.alias("term")).distinct(), "search-terms")
    size = wanted.agg(F.count(F.lit(1)).alias("terms"), F.countDistinct(F.struct("item_id")).alias("items")).first()
    blocks = max(-(-size["terms"] // TERMS), -(-size["items"] // items_a_block), 1)
    number = F.dense_rank().over(W.partitionBy("block").orderBy("item_id")) - 1
    names = wanted.select("item_id").distinct().withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).withColumn("item", number)
    names = stored(names, "search-items")
    numbered = wanted.join(names, wanted["item_id"].eqNullSafe(names["item_id"])).select("block", "item", "term")
    found = []
    for k in range(blocks):
        rows = numbered.where(F.col("block") == k).select("item", "term").toArrow()
        if rows.num_rows:
            found.append(_searched(texts, rows, places, cells, step).select(F.lit(k).alias("block"), "*"))
    if not found:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    some = every.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("block", "item", "salt").orderBy(*order)))
    some = some.where(F.col("rank") <= places).drop("rank", "salt")
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("block", "item").orderBy(*order))).where(F.col("rank") <= places)
    return best.join(names, ["block", "item"]).select("item_id", "rank", "doc_id", "score")
