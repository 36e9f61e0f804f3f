"""Near-duplicate vectors by counting collisions in sorted projections.

Vectors are scaled to length 1, so that cosine t is distance sqrt(2 - 2t). A projection on a random Gaussian direction
moves two vectors at distance d apart by a normal amount with deviation d. For every query a window of the distance
of the threshold is centred on its value in each of `PROJECTIONS` sorted projections, and every vector in the window
collides once. A pair at the threshold collides Binomial(PROJECTIONS, 0.68) times; the count that a pair must
reach is the largest that such a pair misses with a probability below `MISS`. Pairs that reach it are verified by
their cosine in double precision.

Only vectors of equal labels meet. Equal vectors are one vector with a number of copies. A label's vectors are cut into
blocks by hash, and a task compares two blocks, so a label that holds a third of all rows is spread over many tasks and
no task holds more than two blocks. It sends back, per vector, a number of links and one link that spans: never pairs.
The work within a label grows with the square of its distinct vectors, as each is a query against all others.

Cases. A null label, a null or zero vector and one with null or non-finite components has no links and is its own
component. Rows that repeat a vector count as others, whatever their id. Vectors of different lengths never link.
A null vec_id counts as a link, but names no component. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm.common import stored
from talusgrid.llm.graphs import components

PROJECTIONS = 64
MISS = 1e-6
BLOCK = 2048
SEED = 11


def needed_collisions(projections: int, chance: float, miss: float) -> int:
    """Largest count that Binomial(projections, chance) stays below with a probability of at most miss."""
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * chance**k * (1 - chance) ** (projections - k)
        if below > miss:
            return k
    return projections


def _read(kind: str):
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("key", pa.binary()), ("vector", pa.binary())])

    def run(batches):
        for batch in batches:
            keys, vectors = [], []
            for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                vector = None
                if label is not None and values.is_valid and values.values.null_count == 0 and len(values.values):
                    # Adding zero makes -0.0 and 0.0 the same.
                    vector = values.values.to_numpy().astype(kind) + np.zeros(1, dtype=kind)
                    if not np.isfinite(vector).all() or not vector.any():
                        vector = None
                vectors.append(None if vector is None else vector.tobytes())
                keys.append(None if vector is None else hashlib.blake2b(label.encode() + b"\0" + vectors[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], schema=schema)

    return run


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    rows = np.stack([np.frombuffer(v, dtype=kind) for v in vectors]).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def linked(queries: np.ndarray, others: np.ndarray, threshold: float, same: bool, projections: int = PROJECTIONS, miss: float = MISS) -> np.ndarray:
    """Queries x others, true where the cosine is at least threshold and the collisions suffice."""
    reach = math.sqrt(2 - 2 * threshold)
    least = needed_collisions(projections, math.erf(1 / math.sqrt(2)), miss)
    directions = np.random.default_rng(SEED).standard_normal((queries.shape[1], projections))
    ours, theirs = queries @ directions, others @ directions
    order = np.argsort(theirs, axis=0, kind="stable").astype(np.int32)
    # A margin for rounding: it can only let more pairs through to the verification.
    low = np.stack([np.searchsorted(theirs[order[:, j], j], ours[:, j] - reach - 1e-9) for j in range(projections)], axis=1)
    high = np.stack([np.searchsorted(theirs[order[:, j], j], ours[:, j] + reach + 1e-9, "right") for j in range(projections)], axis=1)
    columns = [np.ascontiguousarray(order[:, j]) for j in range(projections)]
    out = np.zeros((len(queries), len(others)), dtype=bool)
    for q in range(len(queries)):
        count = np.zeros(len(others), dtype=np.uint8)
        for column, a, b in zip(columns, low[q].tolist(), high[q].tolist(), strict=True):
            count[column[a:b]] += 1
        found = np.flatnonzero(count >= least)
        out[q, found] = others[found] @ queries[q] >= threshold
    if same:
        np.fill_diagonal(out, False)
    return out


def _spans(links: np.ndarray, same: bool) -> np.ndarray:
    """Per row, then per column, the smallest index that links reach; rows come first. One list if both are the same."""
    rows, columns = links.shape
    label = np.arange(rows if same else rows + columns)
    while True:
        row, column = label[:rows], label if same else label[rows:]
        down = np.where(links, column[None, :], len(label)).min(axis=1, initial=len(label))
        new = label.copy()
        new[:rows] = np.minimum(row, down)
        across = np.where(links, new[:rows, None], len(label)).min(axis=0, initial=len(label))
        new[0 if same else rows :] = np.minimum(new[0 if same else rows :], across)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _cells(kind: str, threshold: float):
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])

    def compared(rows):
        blocks = sorted({r[0] for r in rows})
        first = [r for r in rows if r[0] == blocks[0]]
        same = rows[0][4]
        second = first if same else [r for r in rows if r[0] != blocks[0]]
        if not second:
            return []
        one = _units([r[2] for r in first], kind)
        two = one if same else _units([r[2] for r in second], kind)
        links = linked(one, two, threshold, same)
        if not links.any():
            return []
        weight_one, weight_two = np.array([r[3] for r in first]), np.array([r[3] for r in second])
        names = [r[1] for r in first] + ([] if same else [r[1] for r in second])
        counts = links @ weight_two if same else np.concatenate([links @ weight_two, links.T @ weight_one])
        lead = _spans(links, same)
        return [(names[i], int(counts[i]), names[lead[i]]) for i in np.flatnonzero(counts)]

    def run(batches):
        """Rows come sorted by cell."""
        cell, rows, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "block", "key", "vector", "copies", "same")]
            for number, *row in zip(*columns, strict=True):
                if number != cell:
                    out += compared(rows) if rows else []
                    cell, rows = number, []
                rows.append(row)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        out += compared(rows) if rows else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id), one row per input row."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = stored(read.mapInArrow(_read(kind), "vec_id long, label string, key binary, vector binary"), "vectors")
    known = rows.where("key is not null")
    classes = stored(
        known.groupBy("label", "key", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low")), "vector-classes"
    )
    group = ["label", F.length("vector").alias("bytes")]
    sized = classes.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = classes.select(*group, "key", "vector", "copies").join(sized, ["label", "bytes"])
    own = placed.select("*", F.pmod(F.hash("key"), F.col("blocks")).alias("block"))
    each = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.concat_ws("/", "label", F.col("bytes").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    cells = each.select(cell.alias("cell"), "block", "key", "vector", "copies", (F.col("block") == F.col("other")).alias("same"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_cells(kind, threshold), "key binary, links long, other binary")
    found = stored(found, "vector-links")
    classed = components(found.select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "key")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = classes.select("key", "copies", "low").join(links, "key", "left").join(classed, "key", "left")
    joined = joined.select("key", "low", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("class"))
    names = joined.groupBy("class").agg(F.min("low").alias("component_id"))
    told = joined.join(names, "class").select("key", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.select("vec_id", "key").join(told, "key").select("vec_id", "n_links", "component_id").unionByName(alone)
