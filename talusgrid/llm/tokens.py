"""Token counts of a byte-level BPE tokenizer, by way of distinct pre-tokens.

Such a tokenizer cuts a text into pre-tokens and encodes each on its own, so a text's count is a sum over its pre-tokens
and no ids are needed:

1. One pass finds the corpus's distinct pre-tokens with their frequencies. Each is encoded once, by the library, and its
   pieces are counted.
2. A second pass makes per-document frequencies of pre-tokens, joins them to the counts and sums.

The join is two joins. Frequent pre-tokens, at most `FREQUENT` of them by whole classes of frequency, are broadcast as
two hashes and a count, so hot keys never travel. All others meet their counts by the pre-token itself in a shuffle join;
each has few rows there, as it is not frequent. Both always run and no size of corpus changes that.

Pre-tokens are cut as array operations on code points, with the pattern of this family of tokenizers (contractions, then
letters, numbers and other signs with one blank before them, then white space, of which the last before a word stays
with it). Which code points are letters, numbers and white space is asked of the library itself. Added special tokens
that a text spells out are one token each and divide it, as the library does by default.

Cases. A null text is an empty one; both have no tokens. Repeated rows and null ids get rows of their own. An empty
table gives an empty result. Very long texts and pre-tokens are handled whole. Other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm import hashing
from talusgrid.llm.common import small_batches, stored

LETTER, NUMBER, SIGN, WHITE, SPECIAL = range(5)
FREQUENT = 1 << 20
LIMIT = 1024
SURROGATES = range(0xD800, 0xE000)
BLANK, QUOTE = 32, 39
#: Letters after an apostrophe that make a contraction with it: alone, or followed by another one.
SHORT = "stmd"
DOUBLE = ("re", "ve", "ll")
REST = "array<struct<piece:string,times:bigint>>"


def library(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def checked(path: str) -> tuple[str, list[bytes]]:
    """The tokenizer's definition and the special strings that it finds in texts; an error if its pre-tokens follow other rules."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    parts = json.loads(definition)
    pre = parts["pre_tokenizer"] or {}
    if parts["model"]["type"] != "BPE" or parts["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    added = parts["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError(f"{path}: special tokens that take what stands beside them")
    return definition, [t["content"].encode() for t in added]


def classes(definition: str) -> np.ndarray:
    """The class of every code point, asked of the library.

    In a string of successive code points, a pre-token never holds two classes, as no blank is in it; so one question per
    pre-token settles all its members.
    """
    cut = library(definition).pre_tokenizer.pre_tokenize_str
    table = np.full(0x110000, SIGN, dtype=np.uint8)
    table[BLANK] = WHITE
    for low in range(0, 0x110000, 1 << 15):
        points = [c for c in range(low, low + (1 << 15)) if c not in SURROGATES and c != BLANK]
        for _, (start, end) in cut("".join(map(chr, points))):
            one = chr(points[start])
            kind = next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (SIGN, "!")) if len(cut(before + one)) == 1), WHITE)
            table[points[start:end]] = kind
    return table


def _starts(points: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; begins marks the first ones of texts and of parts between special tokens."""
    n = len(points)
    follows = ~begins[1:]  # code point i + 1 is in the same text as i
    starts = begins.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # White space before something else: its last code point goes alone, or with what follows if it is a blank.
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & follows)
    starts[last] = True
    joined = last[points[last] == BLANK] + 1
    starts[joined] = False
    # Contractions: an apostrophe that starts a pre-token, and its letters.
    quote = np.flatnonzero((points[:-1] == QUOTE) & follows)
    quote = quote[starts[quote]]
    one = points[quote + 1]
    short = np.isin(one, [ord(c) for c in SHORT])
    third = np.minimum(quote + 2, n - 1)
    has_third = (quote + 2 < n) & ~begins[third]
    double = np.zeros(len(quote), dtype=bool)
    for a, b in DOUBLE:
        double |= (one == ord(a)) & (points[third] == ord(b)) & has_third
    starts[quote[short | double] + 1] = False
    ends = np.concatenate([quote[short] + 2, quote[double] + 3])
    starts[ends[ends < n]] = True
    return starts


def _marked(raw: bytes, at: np.ndarray, strings: list[bytes]) -> list[tuple[int, int]]:
    """(start, end) of special strings inside the texts, leftmost first, the longer one of two at one place."""
    out, spot = [], 0
    while found := [(p, -len(s)) for s in strings if (p := raw.find(s, spot)) >= 0]:
        low, size = min(found)
        inside = low - size <= at[np.searchsorted(at, low, "right")]
        spot = low - size if inside else low + 1
        if inside:
            out.append((low, spot))
    return out


def pre_tokens(texts: pa.Array, table: np.ndarray, strings: list[bytes]) -> Iterator[tuple]:
    """(bytes, offsets of rows, starts, ends, rows of the pre-tokens, special tokens per row) of consecutive rows."""
    for _, data, at in hashing.pieces(texts):
        raw = data.tobytes()
        try:
            points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32).copy()
        except UnicodeDecodeError:  # the library sees replacement characters
            fixed = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield from pre_tokens(pa.array(fixed, pa.string()), table, strings)
            continue
        place = np.flatnonzero((data & 0xC0) != 0x80)
        kind = table[points]
        begins = np.zeros(len(points) + 1, dtype=bool)
        begins[np.searchsorted(place, at[:-1])] = True
        for low, high in _marked(raw, at, strings):
            a, b = np.searchsorted(place, [low, high])
            kind[a:b], points[a:b] = SPECIAL, 0
            begins[[a, b]] = True
        first = np.flatnonzero(_starts(points, kind, begins[:-1])) if len(points) else place
        start, end = place[first], np.append(place[first[1:]], len(data)) if len(first) else place
        row = np.searchsorted(at, start, "right") - 1
        special = kind[first] == SPECIAL
        plain = ~special
        yield data, at, start[plain], end[plain], row[plain], np.bincount(row[special], minlength=len(at) - 1)


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different pre-tokens of a piece: an example of each, its two hashes, and for every pre-token which one it is."""
    one, two = hashing.word_hashes(data, start, end, 11), hashing.word_hashes(data, start, end, 12)
    _, example, which = np.unique(one, return_index=True, return_inverse=True)
    if (two != two[example][which]).any():  # one hash for two of them
        _, example, which = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
    return example, one[example], two[example], which.reshape(-1)


def strings_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of the bytes as strings, in the order given."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    spread = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, size)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[spread].tobytes())]).cast(pa.string())


def _frequencies(table: Broadcast, strings: list[bytes]):
    """(piece, times): distinct pre-tokens of every piece of the batch."""

    def run(batches):
        for batch in batches:
            for data, _, start, end, _, _ in pre_tokens(batch.column("text"), table.value, strings):
                if len(start):
                    example, _, _, which = distinct(data, start, end)
                    yield pa.RecordBatch.from_arrays([strings_of(data, start[example], end[example]), pa.array(np.bincount(which), pa.int64())], names=["piece", "times"])

    return run


def _counted(definition: Broadcast):
    """Adds the number of pieces and the two hashes of every pre-token, each encoded once."""

    def run(batches):
        encode = library(definition.value).encode_batch
        for batch in batches:
            sizes = [len(e.ids) for e in encode(batch.column("piece").to_pylist(), add_special_tokens=False)]
            one, two = [], []
            for _, data, at in hashing.pieces(batch.column("piece")):
                one.append(hashing.word_hashes(data, at[:-1], at[1:], 11))
                two.append(hashing.word_hashes(data, at[:-1], at[1:], 12))
            hashes = [pa.array(np.concatenate(h).view(np.int64)) for h in (one, two)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("times"), pa.array(sizes, pa.int64()), *hashes], names=["piece", "times", "pieces", "one", "two"])

    return run


def _most_frequent(counted: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hashes in order, second hashes, counts) of whole classes of frequency, those of 2^k to 2^(k+1) - 1, from the top.

    At most `frequent` rows are collected. Pre-tokens that share their first hash are left to the other join.
    """
    level = F.floor(F.log2("times")).cast("int")
    sizes = sorted((tuple(r) for r in counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)  # 63 rows at most
    total, lowest = 0, 64
    for k, rows in sizes:
        total += rows
        if total > frequent:
            break
        lowest = k
    rows = counted.where(level >= lowest).select("one", "two", "pieces").toArrow()
    one, two, pieces = (rows.column(c).to_numpy() for c in ("one", "two", "pieces"))
    order = np.argsort(one.view(np.uint64))
    one, two, pieces = one.view(np.uint64)[order], two.view(np.uint64)[order], pieces[order]
    again = np.zeros(len(one), dtype=bool)
    again[1:] = one[1:] == one[:-1]
    again[:-1] |= again[1:]
    return one[~again], two[~again], pieces[~again]


def _summed(table: Broadcast, strings: list[bytes], known: Broadcast):
    """(id, doc_id, n_bytes, n_known, rest): sums over frequent pre-tokens, and the frequencies of the others."""

    def looked_up(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Pieces of each pre-token, -1 for those that are not frequent."""
        first, second, pieces = known.value
        if not len(first):
            return np.full(len(one), -1, dtype=np.int64)
        spot = np.minimum(np.searchsorted(first, one), len(first) - 1)
        return np.where((first[spot] == one) & (second[spot] == two), pieces[spot], -1)

    def run(batches):
        task, done = TaskContext.get().partitionId(), 0
        entry_type = pa.struct([("piece", pa.string()), ("times", pa.int64())])
        for batch in batches:
            sums, sizes, counts, words, times_of = [], [], [], [], []
            for data, at, start, end, row, special in pre_tokens(batch.column("text"), table.value, strings):
                rows = len(at) - 1
                sizes.append(np.diff(at))
                if not len(start):
                    sums.append(special)
                    counts.append(np.zeros(rows, dtype=np.int64))
                    continue
                example, one, two, which = distinct(data, start, end)
                pieces = looked_up(one, two)
                # Frequencies per document: one entry per row and different pre-token.
                entry, times = np.unique(row * len(example) + which, return_counts=True)
                owner, piece = entry // len(example), entry % len(example)
                met = pieces[piece] >= 0
                sums.append(special + np.bincount(owner[met], weights=(times * pieces[piece])[met], minlength=rows).astype(np.int64))
                counts.append(np.bincount(owner[~met], minlength=rows))
                left = example[piece[~met]]
                words.append(strings_of(data, start[left], end[left]))
                times_of.append(times[~met])
            n = batch.num_rows
            ids = (np.int64(task) << 33) + np.arange(done, done + n)
            done += n
            each, total, size = (np.concatenate([np.zeros(0, dtype=np.int64), *x]).astype(np.int64) for x in (counts, sums, sizes))
            left = [pa.concat_arrays([pa.array([], pa.string()), *words]), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *times_of]).astype(np.int64))]
            offsets = pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32))
            rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(left, fields=list(entry_type)), mask=pa.array(each == 0))
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id"), pa.array(size), pa.array(total), rest], names=["id", "doc_id", "n_bytes", "n_known", "rest"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit), one row per input row; path is the tokenizer's file."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    definition, strings = checked(path)
    table, definition = context.broadcast(classes(definition)), context.broadcast(definition)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = texts.select("text").mapInArrow(_frequencies(table, strings), "piece string, times long").groupBy("piece").agg(F.sum("times").alias("times"))
    counted = stored(seen.mapInArrow(_counted(definition), "piece string, times long, pieces long, one long, two long"), "token-pieces")
    known = context.broadcast(_most_frequent(counted, frequent))
    rows = stored(texts.mapInArrow(_summed(table, strings, known), f"id long, doc_id long, n_bytes long, n_known long, rest {REST}"), "token-sums")
    rest = rows.where("rest is not null").select("id", F.explode("rest").alias("x")).select("id", "x.piece", "x.times")
    late = rest.join(counted.select("piece", "pieces"), "piece").groupBy("id").agg(F.sum(F.col("times") * F.col("pieces")).alias("n_late"))
    open_rows = rows.where("rest is not null").drop("rest").join(late, "id")
    whole = rows.where("rest is null").select("doc_id", "n_bytes", F.col("n_known").alias("n_tokens"))
    found = whole.unionByName(open_rows.select("doc_id", "n_bytes", (F.col("n_known") + F.col("n_late")).alias("n_tokens")))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
