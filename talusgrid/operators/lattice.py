"""Lattice samples brought to nodes: one shuffle of the nodes, an exact nearest search by joint descent.

Samples stand at whole numbers (lr, lc), at most one each; nodes stand anywhere (v along rows, u along columns).
Samples are gathered into leaves of LEAF x LEAF lattice points, nodes into blocks of BLOCK x BLOCK squares. Every block
gets the leaves it needs, nodes and leaves go through one shuffle by block, and an Arrow function meets them there in
sorted order: it holds the samples of the blocks in a batch of rows and lets the nodes stream past, so a block may have
any number of nodes. Blocks are salted, since one of them may hold a third of all nodes.

Which leaves does a block need? Those within HALO of it, for the corners of its squares and for the nearest sample of
nodes in leaves that have a sample in each 2 x 2 cell: that one is nearer than HALO, and every sample that is not sent
is farther away. The other leaves with nodes, at the edges of the sampled area and beyond, ask for more by a joint
descent. Both trees of nested squares go down together as a table of (node square, sample square) pairs. Of the
children of a pair those stay whose boxes may be nearer than the farthest point of the best box known for the node
square. What is left at the bottom is a thin arc of sample leaves per node leaf.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talusgrid.functions.numeric import literal_rows
from talusgrid.sources.workspace import cut_lineage

LEAF = 8
BLOCK = 32
HALO = 3
SALTS = 8
#: Side of a square's children, and levels enough for all 32-bit positions.
FAN = 4
LEVELS = 15
LEVELS_PER_CUT = 4
#: Both trees start with the lowest level that has at most this many squares.
ROOTS = 512
NO_BLOCK = -(2**30)
#: Bits of a leaf's 64 points whose row and column are even: one per 2 x 2 cell.
CELLS = sum(1 << (LEAF * i + j) for i in range(0, LEAF, 2) for j in range(0, LEAF, 2))


def _index(axis: Column, size: int) -> Column:
    return F.floor(axis / size).cast("int")


def _sample_leaves(samples: DataFrame) -> DataFrame:
    """(li, lj, box, certain) of every leaf with samples; certain: each of its 2 x 2 cells has one."""
    bit = F.expr(f"shiftleft(1L, CAST({LEAF} * pmod(lr, {LEAF}) + pmod(lc, {LEAF}) AS INT))")
    leaves = samples.groupBy(_index(F.col("lr"), LEAF).alias("li"), _index(F.col("lc"), LEAF).alias("lj"))
    boxes = leaves.agg(
        F.min("lr").cast("double").alias("r0"), F.max("lr").cast("double").alias("r1"), F.min("lc").cast("double").alias("c0"),
        F.max("lc").cast("double").alias("c1"), F.bit_or(bit).alias("mask"),
    )
    any_of_cell = " | ".join(f"shiftrightunsigned(mask, {k})" for k in (0, 1, LEAF, LEAF + 1))
    return boxes.select("li", "lj", "r0", "r1", "c0", "c1", F.expr(f"(({any_of_cell}) & {CELLS}L) = {CELLS}L").alias("certain"))


def _placed(u: str, v: str) -> Column:
    return F.col(u).isNotNull() & F.col(v).isNotNull() & ~F.isnan(F.col(u).cast("double")) & ~F.isnan(F.col(v).cast("double"))


def _box(u: str, v: str) -> list[Column]:
    return [f(x).cast("double").alias(name) for name, f, x in (("r0", F.min, v), ("r1", F.max, v), ("c0", F.min, u), ("c1", F.max, u))]


def _nested(boxes: DataFrame) -> DataFrame:
    """(side, level, i, j, box) of the squares of all levels."""
    levels = boxes.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    side = F.pow(F.lit(float(FAN)), "level")
    squares = levels.groupBy("side", "level", F.floor(F.col("li") / side).cast("int").alias("i"), F.floor(F.col("lj") / side).cast("int").alias("j"))
    return squares.agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))


def _squares(nested: DataFrame, side: str, level: int, name: str) -> DataFrame:
    """Squares of one level with their parents; columns start with name."""
    here = nested.where((F.col("side") == side) & (F.col("level") == level))
    parent = [F.floor(F.col(x) / FAN).cast("int").alias(f"{name}p{x}") for x in "ij"]
    return here.select(*parent, *[F.col(x).alias(f"{name}{x}") for x in ("i", "j", "r0", "r1", "c0", "c1")])


def _kept(pairs: DataFrame) -> DataFrame:
    """Pairs of squares (n..., t...) that may hold a node and its nearest sample.

    near and far are squared bounds of the distance between a node and its nearest sample in the box. Each side of
    a box touches a sample, so no node is farther from one than from the farthest point of the side that suits it best.
    """
    near, far, side = [], [], []
    for low, high in (("r0", "r1"), ("c0", "c1")):
        n0, n1, t0, t1 = (F.col(x) for x in (f"n{low}", f"n{high}", f"t{low}", f"t{high}"))
        near.append(F.pow(F.greatest(t0 - n1, n0 - t1, F.lit(0e0)), 2))
        far.append(F.pow(F.greatest(n1 - t0, t1 - n0), 2))
        side.append(F.pow(F.least(F.greatest(F.abs(n0 - t0), F.abs(n1 - t0)), F.greatest(F.abs(n0 - t1), F.abs(n1 - t1))), 2))
    bounds = {"near": near[0] + near[1], "far": F.least(side[0] + far[1], far[0] + side[1])}
    measured = pairs.select("ni", "nj", "ti", "tj", *[x.alias(name) for name, x in bounds.items()])
    bound = F.min("far").over(W.partitionBy("ni", "nj"))
    return measured.withColumn("bound", bound).where(F.col("near") <= F.col("bound")).select("ni", "nj", "ti", "tj")


def _joint_descent(nested: DataFrame, counts: dict[tuple[str, int], int]) -> DataFrame | None:
    """(ni, nj, ti, tj): node leaves with the sample leaves among which their nearest samples are; None if no node asks.

    counts: squares of each side and level.
    """
    if ("n", 0) not in counts or ("t", 0) not in counts:
        return None
    top = next(k for k in range(LEVELS) if counts["n", k] <= ROOTS and counts["t", k] <= ROOTS)
    roots = [tuple(r) for r in nested.where((F.col("side") == "t") & (F.col("level") == top)).select("i", "j").collect()]  # ROOTS at most
    starts = _squares(nested, "n", top, "n").withColumn("root", F.explode(literal_rows(("ti", "tj"), roots)))
    starts = starts.select("*", "root.ti", "root.tj").drop("root")
    kept = _kept(starts.join(_squares(nested, "t", top, "t"), ["ti", "tj"]))
    for level in range(top - 1, -1, -1):
        parents = kept.select(*[F.col(f"{side}{x}").alias(f"{side}p{x}") for side in "nt" for x in "ij"])
        down = parents.join(_squares(nested, "n", level, "n"), ["npi", "npj"]).join(_squares(nested, "t", level, "t"), ["tpi", "tpj"])
        kept = _kept(down)
        if level and (top - level) % LEVELS_PER_CUT == 0:
            kept = cut_lineage(kept)
    return kept


def _requests(nodes: DataFrame, samples: DataFrame, u: str, v: str, wanted: Column) -> tuple[DataFrame | None, tuple]:
    """(bi, bj, li, lj): sample leaves that blocks need beyond those around them; and the box of all nodes."""
    known = _sample_leaves(samples.select("lr", "lc"))
    placed = nodes.where(_placed(u, v))
    leaves = placed.where(wanted).groupBy(_index(F.col(v), LEAF).alias("li"), _index(F.col(u), LEAF).alias("lj")).agg(*_box(u, v))
    asking = leaves.join(known.where("certain").select("li", "lj"), ["li", "lj"], "left_anti")
    whole = placed.agg(*_box(u, v)).select(F.lit(0).alias("li"), F.lit(0).alias("lj"), "*").where("r0 is not null")
    box = ["li", "lj", "r0", "r1", "c0", "c1"]
    sides = [x.select(F.lit(name).alias("side"), *box) for name, x in (("n", asking), ("t", known), ("b", whole))]
    nested = cut_lineage(_nested(sides[0].unionByName(sides[1]).unionByName(sides[2])))
    found = nested.groupBy("side", "level").agg(F.count(F.lit(1)).alias("n"), *[F.max(x).alias(x) for x in box[2:]]).collect()  # 3 x LEVELS rows
    around = next((tuple(r[x] for x in box[2:]) for r in found if (r["side"], r["level"]) == ("b", 0)), (None,) * 4)
    pairs = _joint_descent(nested, {(r["side"], r["level"]): r["n"] for r in found})
    if pairs is None:
        return None, around
    own = BLOCK // LEAF
    asked = pairs.select(_index(F.col("ni"), own).alias("bi"), _index(F.col("nj"), own).alias("bj"), F.col("ti").alias("li"), F.col("tj").alias("lj"))
    return asked.distinct(), around


def _leaf_points(samples: DataFrame, values: list[str]) -> DataFrame:
    """(li, lj, points): the samples of every leaf, LEAF^2 at most."""
    point = F.struct(F.col("lr").cast("int").alias("lr"), F.col("lc").cast("int").alias("lc"), F.array(*[F.col(x).cast("double") for x in values]).alias("x"))
    return samples.groupBy(_index(F.col("lr"), LEAF).alias("li"), _index(F.col("lc"), LEAF).alias("lj")).agg(F.collect_list(point).alias("points"))


def _around(axis: str) -> Column:
    """Blocks along one axis that have squares within HALO of a leaf, and one more towards the far corner of a square."""
    low, high = F.col(axis) * LEAF - HALO - 1, F.col(axis) * LEAF + LEAF - 1 + HALO
    return F.explode(F.sequence(_index(low, BLOCK), _index(high, BLOCK)))


class Samples:
    """The samples sent to one or more blocks, each once, ordered by row, then by column."""

    def __init__(self, row: np.ndarray, col: np.ndarray, x: np.ndarray):
        code, first = np.unique(row.astype(np.int64) << 32 | (col.astype(np.int64) + (1 << 31)), return_index=True)
        self.code, self.row, self.col, self.x = code, row[first].astype(np.int64), col[first].astype(np.int64), x[first]
        self.rows, starts = np.unique(self.row, return_index=True)
        self.starts = np.append(starts, len(self.row))

    def spot(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where samples at lattice points are, and whether there is one."""
        code = row << 32 | (col + (1 << 31))
        spot = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return spot, self.code[spot] == code

    def at(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Values at lattice points, NaN where there is no sample."""
        spot, there = self.spot(row, col)
        return np.where(there[:, None], self.x[spot], np.nan)

    def linear(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Linear value in the lattice triangle around each node, NaN where there is none.

        With all four corners a square is split along its (0,0)-(1,1) diagonal; with one corner missing, the triangle
        of the other three is used if it contains the node.
        """
        i, j = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
        a, b = (v - i)[:, None], (u - j)[:, None]
        q00, q01, q10, q11 = self.at(i, j), self.at(i, j + 1), self.at(i + 1, j), self.at(i + 1, j + 1)
        full = np.where(a >= b, q00 + (q10 - q00) * a + (q11 - q10) * b, q00 + (q01 - q00) * b + (q11 - q01) * a)
        low = np.where((a + b <= 1) & np.isnan(q11), q00 + (q10 - q00) * a + (q01 - q00) * b, np.nan)
        high = np.where((a + b >= 1) & np.isnan(q00), q11 + (q01 - q11) * (1 - a) + (q10 - q11) * (1 - b), np.nan)
        return np.where(np.isnan(full), np.where(np.isnan(low), high, low), full)

    def nearest(self, u: np.ndarray, v: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Values of the nearest sample, ties going to the smaller (lr, lc).

        First the corners of a node's square are looked up, then the points around them: what lies beyond `ring` more
        points is at least ring + 1 away, so a nearer sample is the nearest. Only nodes without one, far from all
        samples or beside large holes, walk over the rows, those of one part of the nodes at a time; parts are neighbours.
        """
        best, which = np.full(len(u), np.inf), np.zeros(len(u), dtype=np.int64)
        open_ = np.arange(len(u))
        for ring in range(2):
            x, y = u[open_], v[open_]
            i, j = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
            near, found = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
            for di in range(-ring, ring + 2):
                for dj in range(-ring, ring + 2):
                    spot, there = self.spot(i + di, j + dj)
                    dv, du = y - (i + di), x - (j + dj)
                    d2 = dv * dv + du * du
                    closer = there & (d2 < near)
                    near[closer], found[closer] = d2[closer], spot[closer]
            best[open_], which[open_] = near, found
            open_ = open_[near >= (ring + 1) ** 2]
            if not len(open_):
                return self.x[which]
        order = open_[np.argsort(part[open_], kind="stable")]
        for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            which[some] = self._over_rows(u[some], v[some])
        return self.x[which]

    def _over_rows(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Positions of the nearest samples at any distance.

        Rows are tried from the middle of the nodes outwards; in a row only the columns on both sides of a node can be nearest.
        """
        best, which = np.full(len(u), np.inf), np.zeros(len(u), dtype=np.int64)
        below, above = v.min(), v.max()
        gap = np.maximum(np.maximum(below - self.rows, self.rows - above), 0)
        for k in np.lexsort((np.abs(self.rows - (below + above) / 2), gap)):
            if gap[k] ** 2 > best.max():
                break
            dv = v - self.rows[k]
            some = np.flatnonzero(dv * dv <= best)
            lo, hi = self.starts[k], self.starts[k + 1]
            spot = np.searchsorted(self.col[lo:hi], u[some])
            for side in (np.maximum(spot - 1, 0), np.minimum(spot, hi - lo - 1)):
                du = u[some] - self.col[lo + side]
                d2 = dv[some] * dv[some] + du * du
                closer = (d2 < best[some]) | ((d2 == best[some]) & (lo + side < which[some]))
                best[some[closer]], which[some[closer]] = d2[closer], lo + side[closer]
        return which


def _met(width: int, u: str, v: str, linear: bool, nearest: bool):
    """Rows come sorted by block, leaves before nodes: nodes with the values found for them."""

    def resampled(held: Samples, x: np.ndarray, y: np.ndarray, wanted: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = np.full((len(x), width), np.nan)
        placed = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
        if not len(held.row) or not len(placed):
            return out
        if linear:
            out[placed] = held.linear(x[placed], y[placed])
        if nearest:
            open_ = placed[np.isnan(out[placed, 0]) & wanted[placed]]
            if len(open_):
                close = held.nearest(x[open_], y[open_], part[open_])
                out[open_] = np.where(np.isnan(out[open_]), close, out[open_])
        return out

    def gathered(parts: list) -> Samples:
        points = [p.flatten() for p in parts]
        row, col = (np.concatenate([p.field(k).to_numpy(zero_copy_only=False) for p in points] or [np.zeros(0, np.int64)]) for k in (0, 1))
        x = np.concatenate([p.field(2).flatten().to_numpy(zero_copy_only=False) for p in points] or [np.zeros(0)])
        return Samples(row, col, x.reshape(-1, width).astype(np.float64))

    def run(batches):
        # All blocks of a batch are looked at together, for they are small: the samples of one are as good for another.
        key, parts, held = None, [], None
        for batch in batches:
            block = np.stack([batch.column(c).to_numpy() for c in ("bi", "bj", "salt")], axis=1)
            if not len(block):
                continue
            is_node = batch.column("kind").to_numpy() == 1
            starts = np.concatenate([[True], (block[1:] != block[:-1]).any(axis=1)])
            last = int(np.flatnonzero(starts)[-1])
            rows = batch.column("node").filter(pa.array(is_node))
            if isinstance(rows, pa.ChunkedArray):
                rows = rows.combine_chunks()
            fields = {rows.type.field(k).name: c for k, c in enumerate(rows.flatten())}
            x, y = (fields[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (u, v))
            wanted = batch.column("wanted").filter(pa.array(is_node)).to_numpy(zero_copy_only=False).astype(bool)
            if key != tuple(block[0]):
                key, parts, held = tuple(block[0]), [], None
            leaves = batch.column("points").filter(pa.array(~is_node))
            if len(leaves) or held is None:
                held = gathered([*parts, leaves]) if len(x) else None
            out = resampled(held, x, y, wanted, np.cumsum(starts)[is_node]) if len(x) else np.zeros((0, width))
            # The last block may go on in the next batch; its samples came before its nodes.
            ends = batch.column("points").slice(last).filter(pa.array(~is_node[last:]))
            if last:
                key, parts, held = tuple(block[last]), [], None
            parts = [*parts, ends] if len(ends) else parts
            found = [pa.array(np.ascontiguousarray(out[:, k]), from_pandas=True) for k in range(width)]
            if len(x):
                yield pa.RecordBatch.from_arrays([*fields.values(), *found], names=[*fields, *[f"value{k}" for k in range(width)]])

    return run


def at_nodes(
    nodes: DataFrame, samples: DataFrame, values: list[str], key: str, u: str, v: str, linear: bool, nearest: bool, only: Column | None = None
) -> DataFrame:
    """Nodes with the samples' values: linear ones if asked for; the nearest sample's, if asked for, where that leaves a gap and `only` holds.

    samples(lr, lc, <values>) holds valid samples, at most one per lattice point; values are doubles, and a NULL or
    NaN counts as missing. A node without a position keeps NULLs.
    """
    wanted = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    asked, (r0, r1, c0, c1) = _requests(nodes, samples, u, v, wanted) if nearest else (None, nodes.where(_placed(u, v)).agg(*_box(u, v)).first())
    # Of a large sample table only the box of the nodes is read here, and below the leaves that were asked for.
    inside = F.lit(False)
    if r0 is not None:
        spans = [(math.floor(low) - HALO - 1, math.floor(high) + HALO + 2) for low, high in ((r0, r1), (c0, c1))]
        inside = F.col("lr").between(*spans[0]) & F.col("lc").between(*spans[1])
    near = _leaf_points(samples.where(inside), values)
    sent = near.withColumn("bi", _around("li")).withColumn("bj", _around("lj")).select("bi", "bj", "points")
    if asked is not None:
        at = [_index(F.col("lr"), LEAF) == F.col("li"), _index(F.col("lc"), LEAF) == F.col("lj")]
        far = _leaf_points(samples.join(asked.select("li", "lj").distinct(), at[0] & at[1], "left_semi"), values)
        sent = sent.unionByName(asked.join(far, ["li", "lj"]).select("bi", "bj", "points"))
    sent = sent.select("bi", "bj", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), "points")

    packed = F.struct(*[nodes[f"`{c}`"] for c in nodes.columns])
    spread = F.pmod(F.xxhash64(key), F.lit(2**20)).cast("int")
    here = nodes.select(
        F.when(_placed(u, v), _index(F.col(v), BLOCK)).otherwise(NO_BLOCK).alias("bi"),
        F.when(_placed(u, v), _index(F.col(u), BLOCK)).otherwise(spread).alias("bj"),
        F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), wanted.alias("wanted"), packed.alias("node"),
    )
    rows = here.unionByName(sent, allowMissingColumns=True)
    sorted_rows = rows.repartition("bi", "bj", "salt").sortWithinPartitions("bi", "bj", "salt", "kind")
    schema = T.StructType([*nodes.schema.fields, *[T.StructField(f"value{k}", T.DoubleType()) for k in range(len(values))]])
    out = sorted_rows.mapInArrow(_met(len(values), u, v, linear, nearest), schema)
    return out.withColumnsRenamed({f"value{k}": x for k, x in enumerate(values)})
