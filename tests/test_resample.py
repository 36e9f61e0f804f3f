import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talusgrid.operators import joins, resample
from talusgrid.operators import lattice as meeting


def points(spark, u, v):
    return spark.createDataFrame(pd.DataFrame({"node_id": np.arange(len(u)), "u": u, "v": v}))


def samples(spark, at):
    rows = [(int(r), int(c), float(1000 * r + c)) for r, c in at]
    return spark.createDataFrame(rows, "lr int, lc int, x double")


def brute_nearest(at, u, v):
    at = np.array(sorted(map(tuple, at)))
    d2 = (v[:, None] - at[:, 0]) ** 2 + (u[:, None] - at[:, 1]) ** 2
    best = at[d2.argmin(axis=1)]
    return 1000.0 * best[:, 0] + best[:, 1]


def lattice(kind, rng):
    if kind == "holes":
        return [(r, c) for r in range(20) for c in range(20) if rng.random() < 0.6]
    if kind == "clusters":
        return [(r + 60 * k, c - 35 * k) for k in range(3) for r in range(6) for c in range(6)]
    return [(-40, 7)]


@pytest.mark.parametrize("kind", ["holes", "clusters", "single"])
def test_nearest_is_exact_at_any_distance(spark, kind):
    rng = np.random.default_rng(5)
    at = lattice(kind, rng)
    u = np.concatenate([rng.uniform(-120, 120, 150), rng.integers(-3, 25, 60) / 2.0])
    v = np.concatenate([rng.uniform(-60, 200, 150), rng.integers(-3, 25, 60) / 2.0])
    got = resample.nearest_on_lattice(points(spark, u, v), samples(spark, at), ["x"])
    got = got.toPandas().sort_values("node_id")["x"].to_numpy()
    assert np.array_equal(got, brute_nearest(at, u, v))


def test_unplaced_nodes_stay_empty(spark):
    nodes = spark.createDataFrame([(1, None, 2.0), (2, 0.1, 0.1)], "node_id long, u double, v double")
    got = resample.nearest_on_lattice(nodes, samples(spark, [(0, 0)]), ["x"])
    assert {r["node_id"]: r["x"] for r in got.collect()} == {1: None, 2: 0.0}


def test_linear_reproduces_a_plane_and_leaves_holes(spark):
    rng = np.random.default_rng(6)
    at = [(r, c) for r in range(8) for c in range(9) if (r, c) != (4, 4)]
    u, v = rng.uniform(0, 8, 400), rng.uniform(0, 7, 400)
    got = resample.linear_on_lattice(points(spark, u, v), samples(spark, at), ["x"]).toPandas().sort_values("node_id")
    x = got["x"].to_numpy()
    near_hole = (abs(u - 4) < 1) & (abs(v - 4) < 1)
    assert np.allclose(x[~near_hole], (1000 * v + u)[~near_hole])
    covered = ~np.isnan(x)
    assert np.allclose(x[covered], (1000 * v + u)[covered])
    assert np.isnan(x[near_hole]).any() and covered[near_hole].any()


def test_filled_prefers_linear_and_respects_only(spark):
    at = [(r, c) for r in range(4) for c in range(4)]
    nodes = points(spark, np.array([0.5, 9.0, 9.0]), np.array([0.5, 1.2, 1.2])).withColumn(
        "inside", F.col("node_id") != 2
    )
    got = resample.filled(nodes, samples(spark, at), ["x"], only=F.col("inside"))
    assert {r["node_id"]: r["x"] for r in got.collect()} == {0: 500.5, 1: 1003.0, 2: None}


@pytest.mark.parametrize("shape", ["disc", "triangle", "row", "column", "one"])
def test_hull_matches_half_planes(spark, shape):
    grid = [(r, c) for r in range(-9, 22) for c in range(-12, 25)]
    at = {
        "disc": [(r, c) for r, c in grid if (r - 6) ** 2 + (c - 5) ** 2 <= 140],
        "triangle": [(0, 0), (17, 4), (6, 21), (5, 5)],
        "row": [(3, c) for c in range(2, 9)],
        "column": [(r, 3) for r in range(2, 9)],
        "one": [(3, 3)],
    }[shape]
    rng = np.random.default_rng(7)
    u, v = rng.uniform(-13, 26, 600), rng.uniform(-10, 23, 600)
    on = rng.integers(0, len(at), 50)
    u[:50], v[:50] = np.array(at)[on, 1], np.array(at)[on, 0]
    dealt = samples(spark, at).repartition(7)  # several partial hulls
    got = resample.inside_hull(points(spark, u, v), dealt).toPandas().sort_values("node_id")["has_soil"]
    p = np.array(at, dtype=float)
    inside = (v >= p[:, 0].min()) & (v <= p[:, 0].max()) & (u >= p[:, 1].min()) & (u <= p[:, 1].max())
    for a in p:
        for b in p:
            side = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
            if (side >= 0).all() and (a != b).any():
                inside &= (b[0] - a[0]) * (u - a[1]) - (b[1] - a[1]) * (v - a[0]) >= -1e-9
    assert np.array_equal(got.to_numpy(), inside)


def test_bilinear_extends_a_plane_and_bounds_at_zero(spark):
    rows = [(r, c, 2.0 * r - 3.0 * c + 4) for r in range(4) for c in range(5)]
    coarse = spark.createDataFrame(rows, "rr int, cc int, mm double")
    rng = np.random.default_rng(8)
    u, v = rng.uniform(-2, 6, 300), rng.uniform(-2, 5, 300)
    got = resample.bilinear(points(spark, u, v), coarse, "mm", 4, 5).toPandas().sort_values("node_id")
    assert np.allclose(got["mm"], np.maximum(0, 2 * v - 3 * u + 4))


def test_bilinear_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    coarse = spark.createDataFrame([(r, c, float(r + c)) for r in range(4) for c in range(5)], "rr int, cc int, mm double")
    u = np.where(np.arange(300) % 3 == 0, 1.5, np.arange(300) / 90)
    out = resample.bilinear(points(spark, u, u / 2), coarse, "mm", 4, 5)
    assert "BroadcastExchange" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert np.allclose(out.toPandas().sort_values("node_id")["mm"], u * 1.5)


def test_hull_of_few_samples_with_long_edges(spark):
    """Three samples span 3 000 001 lattice rows; tasks get three corners, and nothing is joined or shuffled."""
    at = [(0, 0), (3_000_000, 0), (1_500_000, 90)]
    assert resample.convex_hull(samples(spark, at)) == ([(0, 0), (3_000_000, 0)], [(0, 0), (1_500_000, 90), (3_000_000, 0)])
    u, v = np.array([1.0, 1.0, 89.0, 91.0, -1.0, 0.0, 0.0]), np.array([1.0, 1_500_000.5, 1_500_000.0, 1_500_000.0, 7.0, 3_000_000.0, np.nan])
    out = resample.inside_hull(points(spark, u, v), samples(spark, at))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = {r["node_id"]: r["has_soil"] for r in out.collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False, 5: True, 6: False}
    assert not any(r["has_soil"] for r in resample.inside_hull(points(spark, u, v), samples(spark, at).limit(0)).collect())


def test_a_basin_reads_its_box_of_a_large_grid(spark):
    """Of a 2400 x 7200 grid a few nodes need a few squares: they are filtered first and broadcast."""
    coarse = spark.range(2400 * 40).select(
        F.floor(F.col("id") / 40).cast("int").alias("rr"), (F.col("id") % 40).cast("int").alias("cc"), (F.col("id") % 97).cast("double").alias("mm")
    )
    u, v = np.array([3.25, 4.5, 5.0]), np.array([1000.5, 1001.25, 1002.0])
    out = resample.bilinear(points(spark, u, v), coarse, "mm", 2400, 7200)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    value = lambda r, c: float((r * 40 + c) % 97)
    for row, x, y in zip(out.orderBy("node_id").collect(), u, v, strict=True):
        i, j = int(y), int(x)
        a, b = y - i, x - j
        top, low = value(i, j) * (1 - b) + value(i, j + 1) * b, value(i + 1, j) * (1 - b) + value(i + 1, j + 1) * b
        assert row["mm"] == pytest.approx(top * (1 - a) + low * a)


def ring(radius):
    return sorted({(int(round(radius * np.sin(t))), int(round(radius * np.cos(t)))) for t in np.linspace(0, 2 * np.pi, 16 * radius)})


def test_joint_descent_asks_for_leaves_linear_in_the_distance(spark):
    """Nodes in the middle of a ring of samples need the whole ring, but not more than its leaves once per block."""
    asked = []
    for radius in (100, 200, 400):
        at = ring(radius)
        rng = np.random.default_rng(radius)
        nodes = points(spark, rng.uniform(-1, 1, 60), rng.uniform(-1, 1, 60))
        found, _ = meeting._requests(nodes, samples(spark, at), "u", "v", F.lit(True))
        asked.append(found.count())
        got = resample.nearest_on_lattice(nodes, samples(spark, at), ["x"]).toPandas().sort_values("node_id")
        u, v = (nodes.toPandas()[c].to_numpy() for c in "uv")
        assert np.array_equal(got["x"].to_numpy(), brute_nearest(at, u, v))
    assert asked[1] <= 2.5 * asked[0] and asked[2] <= 2.5 * asked[1]


def test_far_nodes_ask_for_few_leaves(spark):
    """A node far beside a full lattice needs the leaves at its near edge only."""
    at = [(r, c) for r in range(128) for c in range(64)]
    nodes = points(spark, np.array([500.0, 500.1, 500.2]), np.array([60.0, 60.5, 61.0]))
    found, box = meeting._requests(nodes, samples(spark, at), "u", "v", F.lit(True))
    assert found.count() <= 6 and {r["lj"] for r in found.collect()} == {7}
    assert box == (60.0, 61.0, 500.0, 500.2)


def test_covered_nodes_ask_for_nothing(spark):
    """Every 2 x 2 cell has a sample, so the nearest one is close by: no descent at all."""
    at = [(r, c) for r in range(64) for c in range(64) if (r + c) % 2 == 0]
    rng = np.random.default_rng(9)
    nodes = points(spark, rng.uniform(0, 64, 300), rng.uniform(0, 64, 300))
    found, _ = meeting._requests(nodes, samples(spark, at), "u", "v", F.lit(True))
    assert found is None
    u, v = (nodes.toPandas()[c].to_numpy() for c in "uv")
    got = resample.nearest_on_lattice(nodes, samples(spark, at), ["x"]).toPandas().sort_values("node_id")["x"].to_numpy()
    assert np.array_equal(got, brute_nearest(at, u, v))


def test_many_nodes_in_one_square(spark):
    """A block with all nodes is salted, and streams past its samples in several batches."""
    at = [(r, c) for r in range(-3, 4) for c in range(-3, 4) if (r, c) != (0, 0)]
    u = np.tile(np.linspace(0, 0.999, 100), 300)
    v = np.repeat(np.linspace(0, 0.999, 300), 100)
    got = resample.filled(points(spark, u, v), samples(spark, at), ["x"]).toPandas().sort_values("node_id")
    upper = u + v >= 1
    assert np.allclose(got["x"].to_numpy()[upper], (1000 * v + u)[upper])
    assert np.array_equal(got["x"].to_numpy()[~upper], brute_nearest(at, u[~upper], v[~upper]))


def test_nodes_keep_their_columns_and_move_once(spark):
    nodes = points(spark, np.array([0.5, np.nan, 7.5]), np.array([0.5, 0.5, 0.5])).selectExpr(
        "node_id", "u", "v", "cast(node_id as string) as label", "array(u) as list", "timestamp'2024-01-01 00:00:00' as t"
    )
    out = resample.filled(nodes, samples(spark, [(r, c) for r in range(2) for c in range(3)]), ["x"])
    assert out.columns == [*nodes.columns, "x"]
    assert [(r["label"], r["t"].year, r["x"]) for r in out.orderBy("node_id").collect()] == [("0", 2024, 500.5), ("1", 2024, None), ("2", 2024, 2.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_a_basin_reads_its_box_of_a_large_lattice(spark, tmp_path):
    """Samples written as a grid are read by a pushed box filter; the result does not change."""
    from talusgrid.sources import tables

    at = [(r, c) for r in range(300) for c in range(80)]
    path = f"{tmp_path}/soil"
    tables.write_grid(samples(spark, at), path, "lr", "lc")
    nodes = points(spark, np.array([10.25, 12.5]), np.array([200.5, 207.0]))
    out = resample.linear_on_lattice(nodes, spark.read.parquet(path), ["x"])
    assert np.allclose(out.toPandas().sort_values("node_id")["x"], [200510.25, 207012.5])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lr,196)" in plan and "LessThanOrEqual(lr,212)" in plan


def met_in_batches(at, u, v, size):
    """Nodes and leaves as `at_nodes` deals them to one task, sorted by block and cut into batches of `size` rows."""
    rows, block = [], meeting.BLOCK
    for k, (x, y) in enumerate(zip(u, v, strict=True)):
        rows.append((int(y // block), int(x // block), 0, 1, True, {"node_id": k, "u": x, "v": y}, None))
    for bi, bj in sorted({(r[0], r[1]) for r in rows}):
        near = [(r, c) for r, c in at if -9 <= r - bi * block < block + 9 and -9 <= c - bj * block < block + 9]
        rows.append((bi, bj, 0, 0, None, None, [{"lr": r, "lc": c, "x": [r * 1000.0 + c]} for r, c in near]))
    rows.sort(key=lambda r: r[:4])
    node = pa.struct([("node_id", pa.int64()), ("u", pa.float64()), ("v", pa.float64())])
    points = pa.list_(pa.struct([("lr", pa.int32()), ("lc", pa.int32()), ("x", pa.list_(pa.float64()))]))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), node, points]
    names = ["bi", "bj", "salt", "kind", "wanted", "node", "points"]
    table = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))}).combine_chunks()
    out = meeting._met(1, "u", "v", False, True)(table.to_batches(max_chunksize=size))
    return pa.Table.from_batches(out).to_pandas().sort_values("node_id")["value0"].to_numpy()


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_blocks_of_a_batch_meet_their_samples_together(size, monkeypatch):
    """The work per block is no part of the time: samples are put in order once per batch, and only nodes without a sample around them walk over rows."""
    rng = np.random.default_rng(3)
    at = [(r, c) for r in range(128) for c in range(128) if rng.random() < 0.8 and not (60 <= r < 66 and 60 <= c < 66)]
    u, v = rng.uniform(0, 127, 600), rng.uniform(0, 127, 600)
    u[:200], v[:200] = np.round(u[:200] * 2) / 2, np.round(v[:200] * 2) / 2  # many ties
    u[200:220], v[200:220] = rng.uniform(61, 64, 20), rng.uniform(61, 64, 20)
    made, walked = [], []
    held, walk = meeting.Samples.__init__, meeting.Samples._over_rows
    monkeypatch.setattr(meeting.Samples, "__init__", lambda self, *a: (made.append(1), held(self, *a))[1])
    monkeypatch.setattr(meeting.Samples, "_over_rows", lambda self, x, y: (walked.append(len(x)), walk(self, x, y))[1])
    got = met_in_batches(at, u, v, size)
    assert np.array_equal(got, np.array([float(r * 1000 + c) for r, c in (min(at, key=lambda p: ((p[0] - y) ** 2 + (p[1] - x) ** 2, p)) for x, y in zip(u, v, strict=True))]))
    assert sum(walked) < 60
    if size == 10_000:
        assert len(made) == 1
