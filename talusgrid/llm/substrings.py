"""Removal of word passages that occur earlier in the corpus, with a count-min prefilter.

A window is `SPAN` consecutive words of one document. A word goes if a window over it has a word sequence that also
starts earlier (smaller doc_id, or the same document further up).

1. Sketch. Every window is represented by its smallest `GRAM`-word gram (by hash, leftmost on ties), so equal windows
   have equal representatives and neighbouring windows mostly share one: counts of representatives are never below
   those of windows. Each task counts its representatives in a two-row count-min sketch and sends it as sorted cells;
   slices of it are added up in tasks of their own and reduced to one bit per cell: counted twice or more. These bits
   are broadcast; their size is fixed by `SKETCH_CELLS` (2**28 cells are 32 MB) whatever the input.
2. Exact pass. Windows whose representative is estimated repeated get a 96-bit hash. Sketches only overestimate, so none
   is lost; where a corpus outgrows the sketch, more windows take this way and the result stays the same. Within a
   batch all but the first of equal windows are settled in place, so a passage that a third of all documents share
   reaches the shuffle once per batch. The rest meet in one sort by hash; all but the first of a hash are repeats.
3. Starts of repeats return to their documents, which drop the words they cover.

Cases. Null and empty texts have no words and no windows, and texts shorter than a window lose nothing. A null doc_id
comes after all others. Rows that repeat doc_id and text are one document and both keep what it keeps; rows with
equal doc_id and other texts are ordered by a hash of the text. An empty table gives an empty result. Other columns
are kept by `without_repeats`.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.llm import hashing
from talusgrid.llm.common import ROW, packed, small_batches

SPAN = 20
GRAM = 7
SKETCH_CELLS = 1 << 28
SLICE = 1 << 20
#: A task sends its sketch whenever it holds this many cells.
FLUSH = 1 << 22
LAST = np.iinfo(np.int64).max


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    have, width = values, 1
    while 2 * width <= n:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    rest = n - width
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def windows(data: np.ndarray, at: np.ndarray, span: int, gram: int):
    """Of a piece of texts: (row, start word within row, representative hash, its place, word hashes, window index)."""
    start, end, row = hashing.words(data, at)
    if len(start) < span:
        return None
    hashed = hashing.word_hashes(data, start, end, 3)
    grams = hashing.window_hashes(hashed, gram, 3)
    bits = max(20, len(grams).bit_length())
    packed_grams = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(packed_grams, span - gram + 1)
    place = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    count = len(start) - span + 1
    inside = np.flatnonzero(row[:count] == row[span - 1 :])
    first_word = np.searchsorted(row, np.arange(len(at) - 1))
    return row[inside], inside - first_word[row[inside]], grams[place[inside]], place[inside], hashed, inside


def cells_of(representative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cell in each row of the sketch."""
    half = np.uint64(SKETCH_CELLS // 2 - 1)
    return (representative & half).astype(np.int64), ((representative >> np.uint64(34)) & half).astype(np.int64) + SKETCH_CELLS // 2


def _sketch_rows(span: int, gram: int):
    schema = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])

    def sent(held):
        cell, count = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(cell, np.arange(0, SKETCH_CELLS + 1, SLICE))
        full = np.flatnonzero(np.diff(edges))
        once, more = [], []
        for k in full:
            part, times = (cell[edges[k] : edges[k + 1]] - k * SLICE).astype(np.uint32), count[edges[k] : edges[k + 1]]
            for out, some in ((once, part[times == 1]), (more, part[times > 1])):
                out.append(zlib.compress(np.diff(some, prepend=np.uint32(0)).tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.zeros(len(full)), pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, data, at in hashing.pieces(batch.column("text")):
                found = windows(data, at, span, gram)
                if found is None or len(found[0]) == 0:
                    continue
                _, _, representative, place, _, _ = found
                new = np.concatenate([[True], place[1:] != place[:-1]])
                for cells in cells_of(representative[new]):
                    held.append(cells)
                    size += len(cells)
            if size > FLUSH:
                yield sent(held)
                held, size = [], 0
        if held:
            yield sent(held)

    return run


def _repeated_cells(frame: pd.DataFrame) -> pd.DataFrame:
    count = np.zeros(SLICE, dtype=np.uint8)
    for once, more in zip(frame["once"], frame["more"], strict=True):
        for part, weight in ((once, 1), (more, 2)):
            cells = np.cumsum(np.frombuffer(zlib.decompress(part), dtype=np.uint32))
            count[cells] = np.minimum(count[cells] + weight, 2)
    bits = np.packbits(count > 1, bitorder="little")
    return pd.DataFrame({"slice": frame["slice"].iloc[:1], "bits": [zlib.compress(bits.tobytes(), 1)]})


def repeated_bits(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """One bit per sketch cell: counted twice or more. Slices arrive one after the other; the whole has SKETCH_CELLS / 8 bytes."""
    parts = texts.select("text").mapInArrow(_sketch_rows(span, gram), "slice int, part int, once binary, more binary")
    merged = parts.groupBy("slice").applyInPandas(_repeated_cells, "slice int, bits binary")
    bits = np.zeros(SKETCH_CELLS // 8, dtype=np.uint8)
    for number, part in merged.collect():  # at most SKETCH_CELLS / SLICE rows of SLICE / 8 bytes
        raw = np.frombuffer(zlib.decompress(bytes(part)), dtype=np.uint8)
        bits[number * (SLICE // 8) : (number + 1) * (SLICE // 8)] = raw
    return bits


def _candidates(span: int, gram: int, bits):
    """Rows (h1, rest, doc, form, settled): windows that may be repeated; settled ones are known to be.

    rest has the other hash bits above and the start below. So all that differs from row to row of a document stands
    together, and shuffled rows compress to little more than their hashes.
    """
    schema = pa.schema([("h1", pa.int64()), ("rest", pa.int64()), ("doc", pa.int64()), ("form", pa.int32()), ("settled", pa.bool_())])

    def marked(cells):
        return (bits.value[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1

    def run(batches):
        for batch in batches:
            ids, forms = batch.column("doc").to_numpy(), batch.column("form").to_numpy()
            parts = []
            for first, data, at in hashing.pieces(batch.column("text")):
                found = windows(data, at, span, gram)
                if found is None or len(found[0]) == 0:
                    continue
                row, start, representative, _, hashed, index = found
                one, two = cells_of(representative)
                hit = np.flatnonzero(marked(one))
                hit = hit[marked(two[hit])]
                if len(hit):
                    h1 = hashing.window_hashes(hashed, span, 5)[index[hit]]
                    h2 = hashing.window_hashes(hashed, span, 7)[index[hit]] >> np.uint64(32) << np.uint64(32)
                    parts.append((h1.view(np.int64), (h2 | start[hit].astype(np.uint64)).view(np.int64), row[hit] + first))
            if not parts:
                continue
            h1, rest, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc, form = ids[row], forms[row]
            order = np.lexsort((rest, form, doc, h1))
            same = np.zeros(len(h1), dtype=bool)
            a, b = order[1:], order[:-1]
            same[1:] = (h1[a] == h1[b]) & (rest[a] >> 32 == rest[b] >> 32)
            # A row that equals the one before in place as well is a copy of the same document: as first as that one.
            twin = np.zeros(len(h1), dtype=bool)
            twin[1:] = same[1:] & (doc[a] == doc[b]) & (form[a] == form[b]) & (rest[a] == rest[b])
            settled = np.zeros(len(h1), dtype=bool)
            settled[order[same]] = True
            go = np.ones(len(h1), dtype=bool)
            go[order[twin]] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[go]) for x in (h1, rest, doc, form, settled)], schema=schema)

    return run


def _repeats(batches):
    """Sorted candidates -> (doc, form, start) of all that are not the first of their hash."""
    schema = pa.schema([("doc", pa.int64()), ("form", pa.int32()), ("start", pa.int32())])
    last, place = None, (0, 0, 0)
    for batch in batches:
        h1, rest, doc, form, settled = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        if len(h1) == 0:
            continue
        high, start = rest >> 32, (rest & 0xFFFFFFFF).astype(np.int32)
        same = np.empty(len(h1), dtype=bool)
        same[1:] = (h1[1:] == h1[:-1]) & (high[1:] == high[:-1])
        same[0] = last is not None and last == (h1[0], high[0])
        # Copies of the first occurrence itself (equal rows of the table) are first as well.
        head = np.maximum.accumulate(np.where(same, -1, np.arange(len(h1))))
        lead = [np.where(head >= 0, x[head], p) for x, p in zip((doc, form, start), place, strict=True)]
        out = settled | (same & ((doc != lead[0]) | (form != lead[1]) | (start != lead[2])))
        last, place = (h1[-1], high[-1]), tuple(x[-1] for x in lead)
        doc, form, start = doc[out], form[out], start[out]
        order = np.argsort(doc, kind="stable")
        yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (doc, form, start)], schema=schema)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("__doc"), F.hash(text).alias("__form"))


def repeat_starts(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text) -> (doc, form, start): word positions where windows begin that occur earlier."""
    bits = docs.sparkSession.sparkContext.broadcast(repeated_bits(docs, span, gram))
    rows = _keyed(docs).select(F.col("__doc").alias("doc"), F.col("__form").alias("form"), "text")
    found = rows.mapInArrow(_candidates(span, gram, bits), "h1 long, rest long, doc long, form int, settled boolean")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.when(F.col("settled"), F.hash("doc", "rest")).otherwise(F.hash("h1", F.expr("shiftright(rest, 32)")))
    ordered = found.repartition(parts, key).sortWithinPartitions("h1", F.expr("shiftright(rest, 32)"), "doc", "form", "rest")
    return ordered.mapInArrow(_repeats, "doc long, form int, start int")


def kept_words(text: str | None, starts, span: int = SPAN) -> tuple[int, list[bytes]]:
    """(number of words, words that no window from `starts` covers)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if starts is None or len(starts) == 0:
        return len(words), words
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    starts = np.unique(np.asarray(starts))
    edge[starts] += 1
    edge[starts + span] -= 1
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _with_starts(docs: DataFrame, span: int, gram: int) -> DataFrame:
    small_batches(docs.sparkSession)
    starts = repeat_starts(docs, span, gram).groupBy("doc", "form").agg(F.collect_list("start").alias("starts"))
    keyed = _keyed(docs.select(packed(docs), "doc_id", "text"))
    same = (F.col("__doc") == F.col("doc")) & (F.col("__form") == F.col("form"))
    return keyed.join(starts, same, "left")


def repeat_counts(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256), one row per input row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                n, kept = kept_words(text.as_py(), starts.values.to_numpy() if starts.is_valid else None, span)
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    joined = _with_starts(docs.select("doc_id", "text"), span, gram).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "starts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs with the kept words, joined by one space, as text; texts that lose nothing stay as they are."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(kept_words(t, s, span)[1]).decode("utf-8", "surrogatepass") for t, s in zip(text, starts, strict=True)])

    joined = _with_starts(docs, span, gram)
    new: Column = F.when(F.col("starts").isNotNull(), cut("text", "starts")).otherwise(F.col("text"))
    done = joined.select(ROW, new.alias("__new"))
    return done.select(*[F.col("__new").alias(c) if c == "text" else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns])
