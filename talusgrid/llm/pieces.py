"""SentencePiece encoding by sampling without replacement, and decoding.

A text is cut into units (spaces with the word after them, or a line feed), whose borders no piece crosses. Each distinct
unit has a lattice: positions, and the pieces that lead from one to another. A backward pass gives every position the
total weight of its completions, so the exact probability of each next piece is known. The lattice of a text is the
chain of its units' lattices.

Gumbel top-k by A-star over prefixes. The search tree holds all prefixes of segmentations; the total weight below a
prefix is exact, so it is a perfect bound and only prefixes of emitted segmentations are opened. The root gets a Gumbel
value; a child that wins inherits its parent's value, and the best of its siblings gets a Gumbel value truncated at
it. So along an emitted segmentation every position holds one waiting group (all ways to leave it there) with one
value. The next segmentation is the group with the largest value: it leaves its owner at that position by another
piece and is free from there on. The k largest perturbed values are the k segmentations, all distinct; with kappa the
next value, the inclusion score of one with log-probability phi is 1 - exp(-exp(phi - kappa)).
Groups whose prefix has a probability below e**-64 are left out: they would win less than once in 2**92 draws.

All random numbers are hashes of seed, row key, rank, unit and position, so a row gets the same result on any cluster.
All texts of a batch piece advance together in array operations; lattices of units are kept per task and dropped when
they grow past `STATES`.

The vocabulary's scores are merge ranks, not probabilities. A piece of rank r weighs (r + 2.7) ** -alpha, the rank law of
Zipf and Mandelbrot, normalised. Characters without a piece become the byte pieces of their UTF-8 form. The vocabulary
is read on the driver from a path and broadcast.

Cases. Null and empty texts give one row of rank 1 without pieces. A text with fewer than k segmentations gives as
many as it has. Rows that repeat a doc_id and text get equal results; a null doc_id is a key of its own. An empty table
gives an empty result. Decoding gives back every text exactly, blanks and U+2581 included; null becomes empty.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm.common import small_batches
from talusgrid.llm.hashing import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
ALPHA = 1.0
SEED = "pieces-1"
PIECE_CHARS = 3 << 18
STATES = 1 << 19
FAINT = -64.0
FREQUENT = 127
UNIT = re.compile(r" *[^ \n]+| +|\n")
#: The same, cut also between a letter and a full stop or comma; for vocabularies without a piece across that place.
FINE_UNIT = re.compile(r" *[A-Za-z\u00C0-\u024F]+(?=[.,])| *[^ \n]+| +|\n")
ACROSS = re.compile(r"[A-Za-z\u00C0-\u024F][.,]")
NONE = np.zeros(0, dtype=np.int64)


class Tree:
    """The pieces as a tree of characters; child steps of many nodes are looked up together."""

    def __init__(self, plain: dict[str, tuple[int, float]]):
        nodes, edges = {"": 0}, []
        for text in plain:
            for end in range(1, len(text) + 1):
                if text[:end] not in nodes:
                    nodes[text[:end]] = len(nodes)
                    edges.append((nodes[text[: end - 1]] << 21 | ord(text[end - 1]), nodes[text[:end]]))
        edges.sort()
        self.keys, self.ends = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        self.piece, self.weight = np.full(len(nodes), -1, dtype=np.int32), np.zeros(len(nodes))
        for text, (number, weight) in plain.items():
            self.piece[nodes[text]], self.weight[nodes[text]] = number, weight
        self.longest = max(map(len, plain))

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each character among the FREQUENT ones with most steps (else 0), and children by node and number. Made in the task."""
        chars, steps = np.unique(self.keys & ((1 << 21) - 1), return_counts=True)
        number = np.zeros(0x110000, dtype=np.uint8)
        number[chars[np.argsort(-steps, kind="stable")[:FREQUENT]]] = np.arange(1, FREQUENT + 1)[: len(chars)]
        children = np.full((len(self.piece), FREQUENT + 1), -1, dtype=np.int32)
        own = number[self.keys & ((1 << 21) - 1)]
        children[(self.keys >> 21)[own > 0], own[own > 0]] = self.ends[own > 0]
        return number, children

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        number, children = self.dense
        own = number[char]
        out = children[node, own].astype(np.int64)
        rare = np.flatnonzero(own == 0)
        if len(rare):
            key = node[rare] << 21 | char[rare]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[spot] == key, self.ends[spot], -1)
        return out


@dataclass
class Vocabulary:
    """Pieces with a plain space for the space mark."""

    tree: Tree
    texts: np.ndarray
    byte_ids: np.ndarray
    floor: float
    unit: re.Pattern

    @staticmethod
    def load(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts, byte_ids, plain = np.full(size, b"", dtype=object), [0] * 256, {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                texts[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                if re.search(r"[^ ] |\n", text):
                    raise ValueError(f"piece {piece!r} crosses the units of this encoder")
                plain[text] = (i, -alpha * math.log(2.7 - model.get_score(i)))
                texts[i] = text.encode()
        norm = math.log(sum(math.exp(w) for _, w in plain.values()))
        tree = Tree({text: (i, w - norm) for text, (i, w) in plain.items()})
        unit = UNIT if any(map(ACROSS.search, plain)) else FINE_UNIT
        return Vocabulary(tree, texts, np.array(byte_ids), min(w for _, w in plain.values()) - norm, unit)

    def decoded(self, ids) -> bytes:
        """UTF-8 text of piece ids, without the space that encoding puts first."""
        return b"".join(self.texts[ids])[1:]


@dataclass
class Lattices:
    """Positions of all units seen, as arrays: position s has the steps from first[s] to first[s + 1], upto their running chances."""

    words: Vocabulary
    begin: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.clear()

    def clear(self) -> None:
        self.begin.clear()
        self.first = np.zeros(1, dtype=np.int64)
        self.upto, self.log_p = np.zeros(0), np.zeros(0)
        self.piece, self.after = NONE.astype(np.int32), NONE

    def add(self, units: list[str]) -> None:
        """Lattices of new units, all at once: a walk down the tree of pieces from every position, then totals from the ends."""
        tree, states = self.words.tree, len(self.first) - 1
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        begins = np.cumsum(sizes) - sizes
        self.begin.update(zip(units, (begins + states).tolist(), strict=True))
        unit = np.repeat(np.arange(len(units)), sizes)
        left = np.repeat(begins + sizes, sizes) - np.arange(len(chars))
        found, alone = [], np.ones(len(chars), dtype=bool)
        at, node = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        for length in range(1, tree.longest + 1):
            node = tree.child(node, chars[at + length - 1])
            whole = np.flatnonzero(node >= 0)
            whole = whole[tree.piece[node[whole]] >= 0]
            found.append((at[whole], tree.piece[node[whole]], tree.weight[node[whole]]))
            if length == 1:
                alone[at[whole]] = False
            go = (node >= 0) & (left[at] > length)
            at, node = at[go], node[go]
            if not len(at):
                break
        at = np.flatnonzero(alone)
        code = chars[at]
        width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        found.append((at, np.where(width == 1, self.words.byte_ids[np.minimum(code, 127)], -code), self.words.floor * width))
        # Steps by position, longest piece first, so that a step is mostly found at once.
        count = np.zeros(len(chars), dtype=np.int64)
        for at, _, _ in found:
            count[at] += 1
        ends = np.cumsum(count)
        cursor, total_steps = ends - count, int(ends[-1])
        piece, weight, size = np.empty(total_steps, dtype=np.int32), np.empty(total_steps), np.empty(total_steps, dtype=np.int64)
        lengths = [*range(1, len(found)), 1]
        for length, (at, numbers, weights) in reversed(list(zip(lengths, found, strict=True))):
            spot = cursor[at]
            piece[spot], weight[spot], size[spot] = numbers, weights, length
            cursor[at] += 1
        # total[p + unit of p]: weight of all completions from p on; each unit has one more place, for its end.
        total, slot = np.zeros(len(chars) + len(units)), np.arange(len(chars)) + unit
        goal = np.repeat(slot, count) + size
        order = np.argsort(left.astype(np.int16) if len(chars) and left.max() < 1 << 15 else left, kind="stable")
        edges = np.searchsorted(left[order], np.arange(1, int(sizes.max()) + 2))
        times = count[order]
        run = np.cumsum(times) - times
        steps = np.repeat((ends - count)[order] - run, times) + np.arange(total_steps)
        run = np.append(run, total_steps)
        share = np.empty(total_steps)
        for k in range(len(edges) - 1):
            lo, hi = edges[k], edges[k + 1]
            if lo == hi:
                continue
            some = steps[run[lo] : run[hi]]
            heads = run[lo:hi] - run[lo]
            sums = weight[some] + total[goal[some]]
            top = np.maximum.reduceat(sums, heads)
            part = np.exp(sums - np.repeat(top, times[lo:hi]))
            whole = np.add.reduceat(part, heads)
            share[some] = part / np.repeat(whole, times[lo:hi])
            here = top + np.log(whole)
            total[slot[order[lo:hi]]] = here
            weight[some] = sums - np.repeat(here, times[lo:hi])
        # Running chances are added up within each position, so they do not depend on the other units.
        first = ends - count
        more = np.flatnonzero(count > 1)
        turn = 1
        while len(more):
            spot = first[more] + turn
            share[spot] += share[spot - 1]
            turn += 1
            more = more[count[more] > turn]
        share[ends - 1] = 1.0
        weight[first[count == 1]] = 0.0
        self.first = np.concatenate([self.first, self.first[-1] + ends])
        self.upto = np.concatenate([self.upto, share])
        self.log_p = np.concatenate([self.log_p, np.minimum(weight, 0.0)])
        self.piece = np.concatenate([self.piece, piece])
        row = np.repeat(np.arange(len(chars)), count)
        self.after = np.concatenate([self.after, np.where(size < left[row], states + row + size, -1)])

    def starts(self, units: list[str]) -> np.ndarray:
        """First position of each unit."""
        if len(self.first) > STATES:
            self.clear()
        new = set(units) - self.begin.keys()
        if new:
            self.add(list(new))
        return np.fromiter(map(self.begin.__getitem__, units), dtype=np.int64, count=len(units))


def uniform(key: np.ndarray, a, b) -> np.ndarray:
    """Numbers in (0, 1) by key and two indexes."""
    x = mix(key + np.uint64(0x9E3779B97F4A7C15) * np.asarray(a).astype(np.uint64))
    x = mix(x + np.uint64(0xD1342543DE82EF95) * np.asarray(b).astype(np.uint64))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def truncated_gumbel(location: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel value with this location, given that it is at most limit."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-limit, np.log(-np.log(u)) - location)


def walk(lattice: Lattices, state: np.ndarray, key: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Free segmentations from given positions to the ends of their units: (steps in order, steps per unit)."""
    live = np.flatnonzero(state >= 0)
    s, count, taken = state[live], np.zeros(len(state), dtype=np.int64), []
    turn = 0
    while len(live):
        step, goal = lattice.first[s], uniform(key[live], unit[live], turn)
        short = np.flatnonzero(lattice.upto[step] < goal)
        while len(short):
            step[short] += 1
            short = short[lattice.upto[step[short]] < goal[short]]
        taken.append((live, step))
        count[live] += 1
        s = lattice.after[step]
        go = s >= 0
        live, s = live[go], s[go]
        turn += 1
    begin = np.cumsum(count) - count
    steps = np.empty(int(count.sum()), dtype=np.int64)
    for turn, (who, step) in enumerate(taken):
        steps[begin[who] + turn] = step
    return steps, count


@dataclass
class Path:
    """The segmentations of one rank for all texts of a piece: steps, the unit of each, and where each text begins."""

    steps: np.ndarray
    unit: np.ndarray
    begin: np.ndarray
    log_p: np.ndarray
    value: np.ndarray
    left_at: np.ndarray
    groups: tuple = ()


def _sums(lattice: Lattices, steps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log-probability of each text's path, added up text by text."""
    out, full = np.zeros(len(begin) - 1), begin[:-1] < begin[1:]
    if full.any():
        out[full] = np.add.reduceat(lattice.log_p[steps], begin[:-1][full])
    return out


def _waiting(lattice: Lattices, path: Path, key: np.ndarray, rank: int) -> None:
    """One truncated value per position of each path after the one where it left its owner."""
    docs = len(path.begin) - 1
    doc = np.repeat(np.arange(docs), np.diff(path.begin))
    log_p = lattice.log_p[path.steps]
    before = np.zeros(len(log_p))
    for a, b in zip(path.begin[:-1].tolist(), path.begin[1:].tolist(), strict=True):
        np.cumsum(log_p[a : b - 1], out=before[a + 1 : b])
    place = np.arange(len(path.steps)) - path.begin[:-1][doc]
    keep = np.flatnonzero((before > FAINT) & (place > path.left_at[doc]))
    off = -np.expm1(log_p[keep])
    keep, off = keep[off > 0], off[off > 0]
    with np.errstate(divide="ignore"):
        location = before[keep] + np.log(off)
    value = truncated_gumbel(location, path.value[doc[keep]], uniform(key[doc[keep]], place[keep] + 1, (1 << 20) + rank))
    edge = np.searchsorted(doc[keep], np.arange(docs + 1))
    path.groups = (keep - path.begin[:-1][doc[keep]], before[keep], value, edge)


def _best(path: Path) -> tuple[np.ndarray, np.ndarray]:
    """Largest waiting value of each text and its index; -inf where none waits."""
    _, _, value, edge = path.groups
    top, spot = np.full(len(edge) - 1, -np.inf), np.full(len(edge) - 1, -1)
    full = edge[:-1] < edge[1:]
    if full.any():
        begins = edge[:-1][full]
        top[full] = np.maximum.reduceat(value, begins)
        doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        hits = np.flatnonzero(value == top[doc])
        spot[doc[hits[::-1]]] = hits[::-1]
    return top, spot


def top_k(lattice: Lattices, states: np.ndarray, doc: np.ndarray, docs: int, key: np.ndarray, k: int) -> tuple[list[Path], np.ndarray]:
    """The k segmentations of every text, best perturbed value first, and the value that comes next.

    states and doc: first position and text of every unit, texts in order. A rank that a text lacks has value -inf.
    """
    unit_begin = np.searchsorted(doc, np.arange(docs + 1))
    local = np.arange(len(doc)) - unit_begin[:-1][doc]
    steps, count = walk(lattice, states, key[doc], local)
    begin = np.concatenate([[0], np.cumsum(count)])[unit_begin]
    root = -np.log(-np.log(uniform(key, 0, 1 << 19)))
    paths = [Path(steps, np.repeat(np.arange(len(doc)), count), begin, _sums(lattice, steps, begin), root, np.full(docs, -1))]
    _waiting(lattice, paths[0], key, 0)
    used: dict[tuple[int, int, int], list[int]] = {}
    for rank in range(1, k + 1):
        found = [_best(p) for p in paths]
        values = np.stack([f[0] for f in found])
        owner = values.argmax(axis=0)
        value = values[owner, np.arange(docs)]
        if rank == k:
            return paths, value
        start, fresh, kept, alternative = np.full(len(doc), -1, dtype=np.int64), np.zeros(len(doc), dtype=bool), [NONE] * docs, np.full(docs, -1, dtype=np.int64)
        left, other = np.full(docs, np.iinfo(np.int64).max), np.zeros(docs)
        picks = uniform(key, rank, (1 << 19) + 1)
        redraw = uniform(key, rank, (1 << 19) + 2)
        for d in np.flatnonzero(value > -np.inf):
            path, spot = paths[owner[d]], found[owner[d]][1][d]
            place, before, waiting, _ = path.groups
            at = path.begin[d] + place[spot]
            chosen = path.steps[at]
            state = int(np.searchsorted(lattice.first, chosen, "right")) - 1
            taken = used.setdefault((d, int(owner[d]), int(place[spot])), [int(chosen)])
            free = np.array([j for j in range(lattice.first[state], lattice.first[state + 1]) if j not in taken], dtype=np.int64)
            mass = np.exp(lattice.log_p[free])
            run = np.cumsum(mass)
            pick = int(free[min(np.searchsorted(run, picks[d] * run[-1]), len(free) - 1)])
            taken.append(pick)
            rest = mass.sum() - math.exp(lattice.log_p[pick])
            waiting[spot] = truncated_gumbel(before[spot] + math.log(rest), value[d], redraw[d]) if len(free) > 1 and rest > 0 else -np.inf
            u = path.unit[at]
            kept[d] = path.steps[path.begin[d] : at]
            alternative[d], left[d] = pick, place[spot]
            start[u], fresh[u] = lattice.after[pick], True
            fresh[u + 1 : unit_begin[d + 1]] = True
            start[u + 1 : unit_begin[d + 1]] = states[u + 1 : unit_begin[d + 1]]
            other[d] = u
        more, count = walk(lattice, np.where(fresh, start, -1), mix(key + np.uint64(rank))[doc], local)
        ends = np.concatenate([[0], np.cumsum(count)])
        unit_of = np.repeat(np.arange(len(doc)), count)
        parts, units, sizes = [], [], np.zeros(docs, dtype=np.int64)
        for d in np.flatnonzero(value > -np.inf):
            path, tail = paths[owner[d]], slice(ends[unit_begin[d]], ends[unit_begin[d + 1]])
            parts += [kept[d], alternative[d : d + 1], more[tail]]
            units += [path.unit[path.begin[d] : path.begin[d] + len(kept[d])], np.array([other[d]], dtype=np.int64), unit_of[tail]]
            sizes[d] = len(kept[d]) + 1 + tail.stop - tail.start
        steps = np.concatenate(parts) if parts else NONE
        begin = np.concatenate([[0], np.cumsum(sizes)])
        paths.append(Path(steps, np.concatenate(units) if units else NONE, begin, _sums(lattice, steps, begin), value, left))
        _waiting(lattice, paths[-1], key, rank)
    return paths, np.full(docs, -np.inf)


def row_keys(ids, seed: str) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest(), "little") for i in ids], dtype=np.uint64)


def encode_texts(lattice: Lattices, ids: list, texts: list[str], k: int, seed: str):
    """(index of text, rank, piece ids, log-probability, perturbed value, inclusion) in turn."""
    units, counts = [], []
    for text in texts:
        found = lattice.words.unit.findall(" " + text) if text else []
        units += found
        counts.append(len(found))
    doc = np.repeat(np.arange(len(texts)), counts)
    paths, kappa = top_k(lattice, lattice.starts(units), doc, len(texts), row_keys(ids, seed), k)
    for rank, path in enumerate(paths, 1):
        numbers = lattice.piece[path.steps]
        with np.errstate(over="ignore"):
            score = -np.expm1(-np.exp(path.log_p - kappa))
        for d in range(len(texts)):
            if rank == 1 or path.value[d] > -np.inf:
                part = numbers[path.begin[d] : path.begin[d + 1]]
                if len(part) and part.min() < 0:
                    part = np.array([x for n in part.tolist() for x in ([n] if n >= 0 else [int(lattice.words.byte_ids[b]) for b in chr(-n).encode("utf-8", "surrogatepass")])])
                yield d, rank, part, path.log_p[d], path.value[d], score[d]


def _groups(sizes: list[int]):
    """Consecutive rows of about PIECE_CHARS characters together."""
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= PIECE_CHARS):
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def encoded(
    docs: DataFrame, path: str = MODEL, k: int = K, alpha: float = ALPHA, seed: str = SEED, digest_only: bool = False, digests: bool = False
) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, rank, n_pieces, log_prob, perturbed, inclusion, pieces), k rows per input row at most.

    With digests, `pieces_sha256`, the hash of the ids as little-endian 32-bit numbers, and `round_trip`, whether decoding them gives back
    the text, come after the pieces; with digest_only, instead of them.
    """
    small_batches(docs.sparkSession)
    words = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path, alpha))
    head = [("doc_id", pa.int64()), ("rank", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())]
    listed, checked = not digest_only, digests or digest_only
    names = [name for name, _ in head] + ["pieces"] * listed + ["pieces_sha256", "round_trip"] * checked

    def run(batches):
        lattice = Lattices(words.value)
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = [n or 0 for n in pa.compute.utf8_length(column).to_pylist()]
            for at, end in _groups(sizes):
                texts = [t or "" for t in column.slice(at, end - at).to_pylist()]
                rows, ranks, parts, *scores = zip(*encode_texts(lattice, ids[at:end], texts, k, seed), strict=True)
                parts = [part.astype("<i4") for part in parts]
                counts = [len(part) for part in parts]
                out = [pa.array(x, kind) for x, (_, kind) in zip(([ids[at + d] for d in rows], ranks, counts, *scores), head, strict=True)]
                if listed:
                    out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), pa.array(np.concatenate(parts))))
                if checked:
                    out.append(pa.array([hashlib.sha256(part).hexdigest() for part in parts], pa.string()))
                    out.append(pa.array([lattice.words.decoded(part) == texts[d].encode() for d, part in zip(rows, parts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    kinds = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, inclusion double"
    more = ", pieces array<int>" * listed + ", pieces_sha256 string, round_trip boolean" * checked
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds + more)


def decoded(encodings: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, rank, pieces) -> (doc_id, rank, text)."""
    words = encodings.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(frames):
        for frame in frames:
            texts = [words.value.decoded(np.asarray(p, dtype=np.int64)).decode("utf-8", "replace") if p is not None else "" for p in frame["pieces"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "rank": frame["rank"], "text": texts})

    return encodings.select("doc_id", "rank", "pieces").mapInPandas(run, "doc_id long, rank int, text string")
