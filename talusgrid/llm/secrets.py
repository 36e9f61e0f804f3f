"""Secrets: fixed formats, and formats learned from them by grammar inference.

Formats. Assignments to names like "password", access keys and long hexadecimal strings are found by patterns.

Grammars. The values found are labelled credentials. For each kind at most `SAMPLE` distinct ones (those with the
smallest hashes, of at most LONGEST characters; a bounded sample whose size is a parameter) make a prefix tree with counts. Its states are merged,
in the order of a red-blue search, wherever the frequencies of ending and of each next character are compatible by
Hoeffding's bound, children included; what remains is a probabilistic automaton of the format. Every other candidate
in the corpus (a run of credential characters outside the spans, its parts between "=", and those between "=", "/" and
".", each of `LEAST` or more, the length of the shortest labelled value) is scored under all automata; of a run that is
a secret the parts are not asked. It is a secret if its likelihood per character is at least that of nearly all labelled
values of the kind and beats a character-pair model of ordinary text, whose counts cover all documents outside the spans, by `MARGIN` bits
a character and `ODDS` bits in all: ordinary words are many, and of short ones some fit a format by chance.

Cases. A null text is an empty one. Without labelled values of a kind there is no grammar for it. Repeated rows get the
same result. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm import hashing
from talusgrid.llm.common import small_batches, stored

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex")

SAMPLE = 2000
#: Longer values are found and scored, but no grammar is fitted on them.
LONGEST = 256
LEAST = 6
CONFIDENCE = 0.05
MARGIN = 1.0
ODDS = 16.0
#: Share of labelled values that may score below the limit of their grammar, and what new values may score less, in bits.
TAIL = 0.02
SLACK = 0.25
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
CODES = 256
PIECE = 1 << 20
#: Likelihoods are summed as whole numbers of this scale, so that sums are exact and do not depend on how texts are batched.
SCALE = 1 << 20
#: Characters after which values that can no longer reach their limit are dropped.
CHECK_EVERY = 8

BREAKS = np.ones(256, dtype=bool)
BREAKS[[ord(c) for c in SYMBOLS]] = False
BREAKS_AT_EQUALS, BREAKS_AT_SIGNS = BREAKS.copy(), BREAKS.copy()
BREAKS_AT_EQUALS[ord("=")] = True
BREAKS_AT_SIGNS[[ord(c) for c in "=/."]] = True
SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, credential), by start, then by kind."""
    out = []
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        out += [(m.start(), m.end(), 0, m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m.group()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def blanked(data: np.ndarray, at: np.ndarray, texts: list[str], spans: list[list]) -> np.ndarray:
    """The bytes of consecutive texts with their spans, given in code points, overwritten by zeros."""
    if not any(spans):
        return data
    data = data.copy()
    for row, (text, found) in enumerate(zip(texts, spans, strict=True)):
        wide = len(text) != at[row + 1] - at[row]
        for start, end, *_ in found:
            lo, hi = (len(text[:start].encode()), len(text[:end].encode())) if wide else (start, end)
            data[at[row] + lo : at[row] + hi] = 0
    return data


def candidates(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) in bytes of every run of credential characters, and of its parts between "=", and between "=", "/" and "."

    Parts between "=" lose the "." and "/" at their end. Only those of LEAST characters or more are told; a part that is its
    whole run is told again.
    """
    signs = (data == ord(".")) | (data == ord("/"))
    solid = np.maximum.accumulate(np.where(signs, -1, np.arange(len(data)))) if len(data) else np.zeros(0, dtype=np.int64)
    runs, parts, pieces = (hashing.words(data, at, breaks) for breaks in (BREAKS, BREAKS_AT_EQUALS, BREAKS_AT_SIGNS))
    parts = (parts[0], solid[parts[1] - 1] + 1, parts[2])
    start, end, row = (np.concatenate(x) for x in zip(runs, parts, pieces, strict=True))
    long = end - start >= LEAST
    return start[long], end[long], row[long]


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
FOUND = "doc_id long, spans array<struct<start:int,end:int,kind:string,value:string>>, pair int, times long"


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often each byte follows each, texts divided by line feeds."""
    raw = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int32)
    return np.bincount(raw[:-1] * CODES + raw[1:], minlength=CODES * CODES)


def _scan(batches):
    """Spans of every text, and at the end a row per pair of characters that the task has seen, with its count."""
    kind = pa.list_(SPAN)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", kind), ("pair", pa.int32()), ("times", pa.int64())])
    pairs, held, size = np.zeros(CODES * CODES, dtype=np.int64), [], 0
    for batch in batches:
        spans = []
        for text in batch.column("text"):
            value = text.as_py() or ""
            found = base_spans(value)
            spans.append([{"start": s, "end": e, "kind": KINDS[k], "value": v} for s, e, k, v in found])
            upto = 0
            for start, end, *_ in found:
                held.append(value[upto : max(start, upto)])
                upto = max(upto, end)
            held.append(value[upto:])
            size += len(value)
            if size > PIECE:
                pairs += pair_counts(held)
                held, size = [], 0
        none = pa.nulls(batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind), none.cast(pa.int32()), none.cast(pa.int64())], schema=schema)
    pairs += pair_counts(held)
    seen = np.flatnonzero(pairs)
    none = pa.nulls(len(seen))
    yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(kind), pa.array(seen, pa.int32()), pa.array(pairs[seen])], schema=schema)


class Automaton:
    """A probabilistic automaton, grown as a prefix tree and reduced by merging compatible states.

    count[s]: values that pass s; final[s]: those that end there; moves[s]: character -> [state, times].
    """

    def __init__(self, values: list[str], confidence: float = CONFIDENCE):
        self.count, self.final, self.moves = [0], [0], [{}]
        for value in values:
            state = 0
            self.count[0] += 1
            for c in value:
                move = self.moves[state].get(c)
                if move is None:
                    self.count.append(0)
                    self.final.append(0)
                    self.moves.append({})
                    move = self.moves[state][c] = [len(self.count) - 1, 0]
                move[1] += 1
                state = move[0]
                self.count[state] += 1
            self.final[state] += 1
        self.width = math.sqrt(0.5 * math.log(2 / confidence))
        self._reduce()

    def _differ(self, part: int, whole: int, other: int, total: int) -> bool:
        return abs(part / whole - other / total) > self.width * (whole**-0.5 + total**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        """Endings and next characters agree here and below. The side of b is a tree, so this ends."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            if n == 0 or m == 0:
                continue
            if self._differ(self.final[a], n, self.final[b], m):
                return False
            for c in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(c), self.moves[b].get(c)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree at b to the automaton at a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for c, (child, times) in self.moves[b].items():
                own = self.moves[a].get(c)
                if own is None:
                    self.moves[a][c] = [child, times]
                else:
                    own[1] += times
                    todo.append((own[0], child))

    def _reduce(self) -> None:
        red, known = [0], {0}
        blue = deque((0, c) for c in sorted(self.moves[0]))
        while blue:
            parent, c = blue.popleft()
            state = self.moves[parent][c][0]
            if state in known:
                continue
            goal = next((r for r in red if self._compatible(r, state)), None)
            if goal is None:
                red.append(state)
                known.add(state)
                blue.extend((state, x) for x in sorted(self.moves[state]))
            else:
                self.moves[parent][c][0] = goal
                self._fold(goal, state)
                for r in red:
                    blue.extend((r, x) for x in sorted(self.moves[r]) if self.moves[r][x][0] not in known)
        self.states = red

    def score(self, value: str) -> float:
        """Mean binary log-likelihood per character; unseen steps have the weight of half an observation."""
        state, total = 0, 0.0
        for c in value:
            n = self.count[state] + 0.5 * len(SYMBOLS)
            move = self.moves[state].get(c)
            total += math.log2(((move[1] if move else 0) + 0.5) / n)
            state = move[0] if move else 0
        return total / max(len(value), 1)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Next state and scaled log-likelihood by state and symbol, states numbered anew; unseen steps lead to the start."""
        number = {s: k for k, s in enumerate(self.states)}
        after = np.zeros((len(self.states), len(SYMBOLS)), dtype=np.int64)
        times = np.full(after.shape, 0.5)
        for s, k in number.items():
            for c, (state, seen) in self.moves[s].items():
                after[k, SYMBOL[ord(c)]] = number[state]
                times[k, SYMBOL[ord(c)]] += seen
        total = np.array([self.count[s] for s in self.states])[:, None] + 0.5 * len(SYMBOLS)
        return after.reshape(-1), np.rint(np.log2(times / total) * SCALE).astype(np.int64).reshape(-1)


def walked(table: tuple[np.ndarray, np.ndarray], data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: float = -math.inf) -> np.ndarray:
    """Scaled log-likelihoods of the values data[start:end], all of them stepping together; far too low where the mean cannot reach limit."""
    after, cost = table
    order = np.argsort(start - end, kind="stable")
    at, size = start[order], (end - start)[order]
    least = np.where(np.isneginf(limit), np.iinfo(np.int64).min // 2, limit * size * SCALE - 1)
    state, total = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    out = np.full(len(at), np.iinfo(np.int64).min // 2)
    step = 0
    while len(at):
        going = int(np.searchsorted(-size, -step))  # those with more than `step` characters come first
        out[order[going:]] = total[going:]
        if step % CHECK_EVERY == 0:
            keep = np.flatnonzero(total[:going] >= least[:going])
            order, at, size, least, state, total = (x[keep] for x in (order, at, size, least, state, total))
        else:
            order, at, size, least, state, total = (x[:going] for x in (order, at, size, least, state, total))
        cell = state * len(SYMBOLS) + SYMBOL[data[at + step]]
        total += cost[cell]
        state = after[cell]
        step += 1
    return out


class Grammars:
    """One automaton and limit per kind, as tables, and the model of ordinary text. Made of arrays only."""

    def __init__(self, samples: dict[str, list[str]], pairs: np.ndarray):
        self.kinds, self.tables, self.limits = [], [], []
        for kind, values in samples.items():
            if values:
                table = Automaton(values).table()
                data = np.frombuffer("".join(values).encode(), dtype=np.uint8)
                size = np.array([len(v) for v in values])
                scores = np.sort(walked(table, data, np.cumsum(size) - size, np.cumsum(size)) / (SCALE * size))
                self.kinds.append(kind)
                self.tables.append(table)
                self.limits.append(float(scores[int(TAIL * (len(scores) - 1))]) - SLACK)
        table = pairs.reshape(CODES, CODES) + 0.1
        self.plain = np.rint(np.log2(table / table.sum(axis=1, keepdims=True)) * SCALE).astype(np.int64).reshape(-1)

    def verdicts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Per value the number of the kind whose format it has, or -1; the first of those that it fits best."""
        size = end - start
        running = np.zeros(max(len(data), 1), dtype=np.int64)
        np.cumsum(self.plain[data[:-1].astype(np.int64) * CODES + data[1:]], out=running[1:])
        plain = (running[end - 1] - running[start]) / (SCALE * np.maximum(size - 1, 1))
        best, which = np.full(len(size), -np.inf), np.full(len(size), -1)
        for k, (table, limit) in enumerate(zip(self.tables, self.limits, strict=True)):
            score = walked(table, data, start, end, limit) / (SCALE * size)
            fits = (score >= limit) & (score - plain >= np.maximum(MARGIN, ODDS / size)) & (score > best)
            best[fits], which[fits] = score[fits], k
        return which


def grammars(found: DataFrame, sample: int = SAMPLE) -> Grammars:
    """Fits the automata on the driver from `sample` values per kind at most; of pair counts one row per pair arrives."""
    spans = found.where("spans is not null").select(F.explode("spans").alias("s"))
    values = spans.where(F.length("s.value") <= LONGEST).select("s.kind", "s.value").distinct()
    samples = {
        kind: [r.value for r in values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()] for kind in KINDS
    }
    total = np.zeros(CODES * CODES, dtype=np.int64)
    counts = found.where("pair is not null").groupBy("pair").agg(F.sum("times").alias("times")).toArrow()  # CODES^2 rows at most
    total[counts.column("pair").to_numpy()] = counts.column("times").to_numpy()
    return Grammars(samples, total)


def added_spans(data: np.ndarray, at: np.ndarray, texts: list[str], model: Grammars) -> dict[int, list[dict]]:
    """Row -> spans in code points of values that have a learned format, for consecutive texts with their base spans blanked."""
    start, end, row = candidates(data, at)
    if not len(start):
        return {}
    hashed = hashing.word_hashes(data, start, end, 31)
    _, example, which = np.unique(hashed, return_index=True, return_inverse=True)
    kind = model.verdicts(data, start[example], end[example])[which]
    out: dict[int, list[dict]] = {}
    for k in np.flatnonzero(kind >= 0):
        text, raw = texts[row[k]], data[at[row[k]] : start[k]]
        value = data[start[k] : end[k]].tobytes().decode()
        begin = int(np.count_nonzero((raw & 0xC0) != 0x80)) if len(text) != at[row[k] + 1] - at[row[k]] else len(raw)
        out.setdefault(int(row[k]), []).append({"start": begin, "end": begin + len(value), "kind": f"like_{model.kinds[kind[k]]}", "value": value})
    return {r: outer(spans) for r, spans in out.items()}


def detected(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, spans, all_spans), one row per input row; added spans have kind "like_<kind>".

    Spans are ordered by start, then by kind as listed, added ones after base ones.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(texts.mapInArrow(_scan, FOUND), "secret-spans")
    model = docs.sparkSession.sparkContext.broadcast(grammars(found, sample))
    order = {k: i for i, k in enumerate((*KINDS, *(f"like_{k}" for k in KINDS)))}

    def judged(batches):
        for batch in batches:
            base, more = [], []
            for first, data, at in hashing.pieces(batch.column("text")):
                here = [t or "" for t in batch.column("text").slice(first, len(at) - 1).to_pylist()]
                spans = [base_spans(t) for t in here]
                new = added_spans(blanked(data, at, here, spans), at, here, model.value)
                for row, found in enumerate(spans):
                    own = [{"start": s, "end": e, "kind": KINDS[k], "value": v} for s, e, k, v in found]
                    base.append(own)
                    more.append(sorted(own + new[row], key=lambda s: (s["start"], order[s["kind"]], s["end"])) if row in new else own)
            kind = pa.list_(SPAN)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(more, kind)], names=["doc_id", "spans", "all_spans"])

    kind = "array<struct<start:int,end:int,kind:string,value:string>>"
    return texts.mapInArrow(judged, f"doc_id long, spans {kind}, all_spans {kind}")


def outer(spans: list[dict]) -> list[dict]:
    """Spans by start, without those inside another one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if not out or s["start"] >= out[-1]["end"]:
            out.append(s)
    return out
