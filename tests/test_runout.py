import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_grid import raster

from talusgrid.operators import drainage, graph, runout
from talusgrid.operators.blocks import NEIGHBOURS
from talusgrid.sources import tables
from talusgrid.sources.workspace import cut_lineage


def brute_descent(z):
    rows, cols = z.shape
    target = np.full(z.shape, -1)
    for r in range(rows):
        for c in range(cols):
            best = 0.0
            for i, j in NEIGHBOURS:
                if 0 <= r + i < rows and 0 <= c + j < cols:
                    drop = (z[r, c] - z[r + i, c + j]) / (math.sqrt(2) if i and j else 1.0)
                    if drop > best:
                        best, target[r, c] = drop, (r + i) * cols + c + j
    return target.ravel()


def surface(kind):
    rng = np.random.default_rng(9)
    if kind == "noise":
        return np.round(rng.random((19, 23)) * 20) / 2  # many ties and flats
    if kind == "ramp":
        return np.add.outer(np.arange(30)[::-1] * 10.0, np.zeros(11)) + rng.random((30, 11))
    z = np.add.outer(np.arange(40.0), np.arange(40.0) * 0.01)
    z[5, 5] = np.nan
    return z


@pytest.mark.parametrize("kind", ["noise", "ramp", "plane"])
@pytest.mark.parametrize("block", [4, 7, 128])
def test_descent_and_terminals_match_brute_force(spark, kind, block):
    z = surface(kind)
    flow = graph.steepest_descent(raster(spark, z), block)
    got = flow.toPandas().sort_values("node_id")
    target = brute_descent(z)
    assert np.array_equal(got["target_id"].fillna(-1).to_numpy(dtype=int), target)
    reach = drainage.path_lengths(drainage.terminals(flow, block), 1.0).toPandas().set_index("node_id")
    assert len(reach) == z.size
    cols = z.shape[1]
    for node in range(z.size):
        at, metres, hops = node, 0.0, 0
        while target[at] >= 0:
            r, c = divmod(at, cols)
            i, j = divmod(target[at], cols)
            metres += math.sqrt(2) if r != i and c != j else 1.0
            at, hops = target[at], hops + 1
        assert reach.at[node, "terminal_id"] == at and reach.at[node, "hops"] == hops
        assert reach.at[node, "path_m"] == pytest.approx(metres)


def test_one_outlet_for_all_paths(spark):
    """A third of all cells and more drain through one cell."""
    z = np.abs(np.add.outer(np.zeros(60), np.arange(-20.0, 21.0))) + np.arange(60)[:, None] * 0.1
    flow = graph.steepest_descent(raster(spark, z), 8)
    for reach in (drainage.terminals(flow, 8), drainage.cell_terminals(raster(spark, z), 8)):
        ends = reach.groupBy("terminal_id").count().collect()
        assert [(r["terminal_id"], r["count"]) for r in ends] == [(20, z.size)]


def test_duplicate_cells_are_refused(spark):
    cells = raster(spark, np.zeros((3, 3)))
    cells = cells.union(cells.limit(1))
    with pytest.raises(Exception, match="not unique"):
        graph.steepest_descent(cells, 4).collect()


def debris(spark, z, block):
    k = F.col("node_id")
    loaded = raster(spark, z).withColumns({"h": (k % 13) * 1.1, "share": (k % 7) / 6.0})
    return graph.steepest_descent(loaded, block, carry=("h", "share"))


def test_routing_steps_equal_plain_arrays(spark):
    """Transfer and overflow in NumPy, one step after the other."""
    z = surface("noise")
    rows, cols = z.shape
    state = cut_lineage(debris(spark, z, 6))
    got = runout.route_steps(state, 5, 4.0, rows, cols).toPandas().set_index("node_id")["h"].sort_index()
    cells = state.toPandas().set_index("node_id").sort_index()
    h, share, target = cells["h"].to_numpy(), cells["share"].to_numpy(), cells["target_id"]
    goes = target.notna().to_numpy()
    goal = target.fillna(0).to_numpy(dtype=int)
    for _ in range(5):
        sent = np.where(goes & (h > runout.MOBILE_DEPTH_M), h * share, 0.0)
        h = h - sent + np.bincount(goal, sent, rows * cols)
        over = np.maximum(h - 4.0, 0.0).reshape(rows, cols)
        h = h - over.ravel()
        for di, dj in NEIGHBOURS:
            i, j = np.clip(np.arange(rows) + di, 0, rows - 1), np.clip(np.arange(cols) + dj, 0, cols - 1)
            spread = np.zeros((rows, cols))
            np.add.at(spread, np.ix_(i, j), over / 8)
            h = h + spread.ravel()
    assert np.allclose(got, h, rtol=0, atol=1e-9)
    assert got.sum() == pytest.approx(cells["h"].sum())


def test_single_failure_on_a_ramp(spark):
    """One node of a 20 x 20 ramp fails at hour 2: nothing before, one slab from then on."""
    z = np.repeat((20 - np.arange(20.0))[:, None] * 10, 20, axis=1)
    hours = raster(spark, z).select("node_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("hr"))
    hours = hours.withColumn("fs", F.when((F.col("node_id") == 210) & (F.col("hr") == 2), 0.5).otherwise(1.5))
    assert [tuple(r) for r in runout.releases(hours).collect()] == [(210, 2, 1.5)]
    history = runout.erosion_history(hours, hours=6).orderBy("hr").collect()
    assert [r["cumulative_m"] for r in history] == [0, 0, 1.5, 1.5, 1.5, 1.5]
    flow = graph.steepest_descent(raster(spark, z))
    end = drainage.deposits(runout.releases(hours), drainage.terminals(flow)).collect()
    assert [(r["terminal_id"], r["deposit_m"]) for r in end] == [(390, 1.5)]


def test_every_release_is_in_the_history(spark):
    """Hours past the 24 of a storm count as well."""
    hours = spark.createDataFrame([(1, 3, 0.5), (2, 30, 0.5), (2, 31, 0.4), (3, 5, 2.0)], "node_id long, hr int, fs double")
    history = runout.erosion_history(hours).orderBy("hr").collect()
    assert [r["hr"] for r in history] == list(range(32))
    assert sum(r["n_released"] for r in history) == 2 and history[-1]["cumulative_m"] == 3.0
    assert runout.erosion_history(hours.limit(0)).count() == 24


def test_cells_left_of_and_above_zero(spark):
    cells = spark.createDataFrame([(1, -1, 0, 5.0), (2, 0, 0, 7.0), (3, -1, -1, 9.0)], "node_id long, r int, c int, elevation_m double")
    got = {r["node_id"]: r["target_id"] for r in graph.steepest_descent(cells, 4).collect()}
    assert got == {1: None, 2: 1, 3: 1}


def test_mesh_edges_are_symmetric_and_complete(spark):
    cells = raster(spark, np.zeros((6, 9)))
    pairs = {(r["src"], r["dst"]) for r in graph.mesh_edges(cells, 6, 9).collect()}
    assert len(pairs) == 2 * (6 * 8 + 5 * 9)
    assert all((b, a) in pairs for a, b in pairs)


@pytest.mark.parametrize("block", [3, 8, 128])
def test_throughflow_is_the_sum_of_all_upstream_cells(spark, block):
    """Paths that leave blocks and come back, several into one exit, against walking every path."""
    rng = np.random.default_rng(block)
    n = 20
    z = rng.uniform(0, 3, n * n) + 2 * np.abs(np.arange(n * n) % n - 9) + 0.2 * (np.arange(n * n) // n)
    rows = [(k, k // n, k % n, float(z[k]), None if k % 7 == 0 else float(k % 5)) for k in range(n * n)]
    cells = spark.createDataFrame(rows, "node_id long, r int, c int, elevation_m double, depth double")
    got = {r["node_id"]: r["through"] for r in drainage.throughflow(cells, "depth", block).collect()}
    target = {r["node_id"]: r["target_id"] for r in graph.steepest_descent(cells).collect()}
    want = dict.fromkeys(range(n * n), 0.0)
    for k, *_, depth in rows:
        at = k
        while at is not None:
            want[at] += depth or 0.0
            at = target[at]
    assert got == pytest.approx(want)


def test_stored_runs_join_without_an_exchange(spark):
    reach = tables.write_bucketed(spark.range(1000).selectExpr("id AS node_id", "id % 7 AS terminal_id"), "terminals", ["node_id"])
    released = tables.write_bucketed(spark.range(0, 1000, 3).selectExpr("id AS node_id", "1.5D AS depth_m"), "releases", ["node_id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = released.join(reach, "node_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        out = drainage.deposits(released, reach)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the sum by terminal
        assert sum(r["n_releases"] for r in out.collect()) == 334
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
