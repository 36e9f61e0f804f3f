"""Language identification of mixed texts by expectation maximisation.

Learning. Letters are lower-cased, runs of other characters count as one blank; every three characters fall into one of
`CELLS` cells by hash. Cell counts per language are added up by task, then by language and cell, over all learnable documents;
only the sums (CELLS numbers per language) reach the driver and are broadcast.

Inference. A document is a mixture of languages: each of its trigrams comes from language l with probability share[l] and
then has l's cell probability. Expectation maximisation estimates the shares of all documents of a piece together, as
array operations, until no shares at all can raise a log-likelihood by more than TOLERANCE (the bound follows from the
gradient). A set of languages is worth its log-likelihood less PENALTY * log(trigrams) / 2 for each language but one. If all
languages together do not gain one such penalty over the best single one, no set does, and that one is taken: so it is for nearly
all documents, and most are known early by the same bound. From the others languages are removed one at a time, always
the one whose removal, with shares fitted anew, costs least, as long as that is at most a penalty. The
prediction is the language with the largest share, and the share is its score.

Cases. Null texts and texts without a letter are `und` with score 0, and so is everything if nothing could be learned.
A null doc_id has no checksum: such documents are neither held out nor learned from. Repeated rows are learned from as
often as they occur and get equal predictions. An empty table gives an empty result. Languages and sources of documents
are never inputs of a prediction. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm.common import small_batches

CELLS = 1 << 15
PIECE = 1 << 20
PENALTY = 8.0
#: Log-likelihood, in nats, that shares may miss, and rounds after which shares are taken as they are.
TOLERANCE = 0.01
ROUNDS = 2000
SMOOTH = 0.5
#: Languages that a learning task holds counts of before it sends them.
HELD = 256


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell) of every trigram with a letter in its middle, and whether each text has a letter."""
    joined = " " + "  ".join(t.lower() for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t.lower()) for t in texts])
    doc = np.repeat(np.arange(len(texts)), sizes + 2)
    letter = _letters()[codes]
    value = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    value, doc, letter = value[keep], doc[keep], letter[keep]
    # Every text's letters are followed by a blank now, and the first text's are preceded by none.
    value = np.concatenate([[np.uint32(32)], value])
    if len(value) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=bool)
    mixed = value[:-2] * np.uint32(0x9E3779B1) ^ value[1:-1] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F) ^ value[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    cell = (mixed >> np.uint32(17)).astype(np.int64)
    middle = letter[: len(cell)]
    some = np.zeros(len(texts), dtype=bool)
    some[doc[letter]] = True
    return doc[: len(cell)][middle], cell[middle], some


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    held, size, first = [], 0, 0
    for i, text in enumerate(texts.to_pylist()):
        held.append(text or "")
        size += len(held[-1])
        if size >= PIECE:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _learn(batches):
    """(lang, cell, times) of what the task has read; at most HELD languages are held at a time."""
    held: dict[str, np.ndarray] = {}

    def sent():
        for name, counts in held.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(counts[cells])], names=["lang", "cell", "times"])
        held.clear()

    for batch in batches:
        names = batch.column("lang").to_pylist()
        for first, texts in _pieces(batch.column("text")):
            doc, cell, _ = trigrams(texts)
            own = sorted({names[first + i] for i in range(len(texts))})
            number = {name: k for k, name in enumerate(own)}
            lang = np.array([number[names[first + i]] for i in range(len(texts))])
            for k, name in enumerate(own):
                counts = np.bincount(cell[lang[doc] == k], minlength=CELLS)
                held[name] = held[name] + counts if name in held else counts.astype(np.int64)
        if len(held) > HELD:
            yield from sent()
    yield from sent()


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """docs(text, lang) -> (languages, cell probabilities of each: CELLS x languages)."""
    small_batches(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    sums = rows.mapInArrow(_learn, "lang string, cell int, times long").groupBy("lang", "cell").agg(F.sum("times").alias("times")).toArrow()  # CELLS per language at most
    if not sums.num_rows:
        return [], np.zeros((CELLS, 0))
    names, lang = np.unique(np.array(sums.column("lang").to_pylist()), return_inverse=True)
    table = np.full((CELLS, len(names)), SMOOTH)
    table[sums.column("cell").to_numpy(), lang] += sums.column("times").to_numpy()
    return names.tolist(), table / table.sum(axis=0)


def cell_counts(doc: np.ndarray, cell: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, times), ordered by text."""
    if docs * CELLS <= 1 << 24:
        dense = np.bincount(doc * CELLS + cell, minlength=docs * CELLS)
        key = np.flatnonzero(dense)
        return key // CELLS, key % CELLS, dense[key]
    key, times = np.unique(doc * CELLS + cell, return_counts=True)
    return key // CELLS, key % CELLS, times


class Mixtures:
    """Documents as entries (cell probabilities by language, times), ordered by document."""

    def __init__(self, chance: np.ndarray, times: np.ndarray, size: np.ndarray):
        self.chance, self.times, self.size = chance, times, size
        self.begin = np.cumsum(size) - size
        self.own = np.repeat(np.arange(len(size)), size)
        self.total = np.add.reduceat(times, self.begin) if len(size) else np.zeros(0)

    def only(self, keep: np.ndarray) -> Mixtures:
        entries = keep[self.own]
        return Mixtures(self.chance[entries], self.times[entries], self.size[keep])

    def ascent(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of each document, the shares of the next round, and what any shares of the same languages can gain at most."""
        mix = np.maximum(np.einsum("ij,ij->i", self.chance, share[self.own]), 1e-300)
        found = np.add.reduceat(np.log(mix) * self.times, self.begin)
        slope = np.add.reduceat(self.chance * (self.times / mix)[:, None], self.begin) / self.total[:, None]
        gain = self.total * np.log(np.maximum(np.where(share > 0, slope, 0).max(axis=1), 1))
        return found, share * slope, gain


def fitted(docs: Mixtures, share: np.ndarray, enough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihood) by expectation maximisation from `share`; languages with share 0 stay out.

    A document is done when nothing can gain TOLERANCE, or when it cannot come above `enough`.
    """
    out, found = share.copy(), np.full(len(share), -np.inf)
    place, enough = np.arange(len(share)), np.full(len(share), -np.inf) if enough is None else enough
    for k in range(ROUNDS):
        if not len(place):
            break
        value, further, gain = docs.ascent(share)
        out[place], found[place] = share, value
        going = (gain > TOLERANCE) & (value + gain > enough)
        share = further / further.sum(axis=1, keepdims=True)
        if going.mean() < 0.75:  # documents that are done may go on for a while: their shares only get better
            docs, place, share, enough = docs.only(going), place[going], share[going], enough[going]
        elif not going.any():
            break
    return out, found


def selected(docs: Mixtures) -> np.ndarray:
    """Shares of each document (documents x languages) in the set of languages chosen for it."""
    count, languages = len(docs.size), docs.chance.shape[1]
    alone = np.add.reduceat(np.log(docs.chance) * docs.times[:, None], docs.begin)
    best = alone.argmax(axis=1)
    out = np.zeros((count, languages))
    out[np.arange(count), best] = 1
    penalty = PENALTY * np.log(np.maximum(docs.total, 2)) / 2
    enough = alone.max(axis=1) + penalty
    share, value = fitted(docs, np.full((count, languages), 1 / languages), enough)
    place = np.flatnonzero(value > enough)
    docs, share, value, penalty = docs.only(value > enough), share[place], value[place], penalty[place]
    while len(place):
        cost, rest, reached = np.full(len(place), np.inf), share.copy(), value.copy()
        for k in range(languages):
            asked = share[:, k] > 0
            trial = share[asked]
            trial[:, k] = 0
            left = trial.sum(axis=1)
            # Where the others have next to nothing they start alike.
            trial = np.where((left < 1e-9)[:, None], (share[asked] > 0) * (np.arange(languages) != k), trial)
            trial /= trial.sum(axis=1, keepdims=True)
            again, without = fitted(docs.only(asked), trial)
            cheaper = value[asked] - without < cost[asked]
            where = np.flatnonzero(asked)[cheaper]
            cost[where], rest[where], reached[where] = (value[asked] - without)[cheaper], again[cheaper], without[cheaper]
        drops = cost <= penalty
        out[place[~drops]] = share[~drops]
        single = drops & ((rest > 0).sum(axis=1) == 1)
        out[place[single]] = rest[single] > 0
        going = drops & ~single
        docs, place, share, value, penalty = docs.only(going), place[going], rest[going], reached[going], penalty[going]
    return out


def shares(doc: np.ndarray, cell: np.ndarray, times: np.ndarray, docs: int, table: np.ndarray) -> np.ndarray:
    """Language shares of each text (docs x languages), chosen by penalised likelihood; texts without trigrams get zeros."""
    out = np.zeros((docs, table.shape[1]))
    if len(doc):
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[begin]] = selected(Mixtures(table[cell], times.astype(np.float64), np.diff(np.append(begin, len(doc)))))
    return out


def _predict(model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])

    def run(batches):
        names, table = model.value
        for batch in batches:
            told, scores, sets = [], [], []
            for _, texts in _pieces(batch.column("text")):
                doc, cell, some = trigrams(texts)
                share = shares(*cell_counts(doc, cell, len(texts)), len(texts), table) if names else np.zeros((len(texts), 0))
                for i in range(len(texts)):
                    if not some[i] or not names:
                        told.append("und")
                        scores.append(0.0)
                        sets.append([])
                        continue
                    k = int(share[i].argmax())
                    told.append(names[k])
                    scores.append(min(float(share[i, k]), 1.0))
                    sets.append([{"lang": names[j], "share": float(share[i, j])} for j in np.flatnonzero(share[i])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, f.type) for x, f in zip((told, scores, sets), list(schema)[1:], strict=True)]], schema=schema)

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred, score, langs), one row per input row; langs has all shares found."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, langs array<struct<lang:string,share:double>>")
