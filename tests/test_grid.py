import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talusgrid.functions import numeric
from talusgrid.operators import grid, layers
from talusgrid.operators.joins import lookup_join
from talusgrid.operators.quantiles import exact_percentiles, percentiles_by_group


def raster(spark, values: np.ndarray, name: str = "elevation_m"):
    rows, cols = values.shape
    r, c = np.divmod(np.arange(rows * cols), cols)
    data = pd.DataFrame({"node_id": np.arange(rows * cols), "r": r.astype("int32"), "c": c.astype("int32")})
    data[name] = values.ravel()
    return spark.createDataFrame(data)


def array_of(df, rows, cols, name):
    out = np.full((rows, cols), np.nan)
    for row in df.collect():
        out[row["r"], row["c"]] = row[name]
    return out


def test_tiles_of_several_bands(spark):
    """2 x 3 tiles with two bands side by side, two tiles across."""
    z = np.random.default_rng(2).random((4, 6, 2))
    tiles = [(i * 2 + j, z[2 * i : 2 * i + 2, 3 * j : 3 * j + 3].reshape(-1).tolist()) for i in range(2) for j in range(2)]
    table = spark.createDataFrame(tiles, "tile_id long, tile_values array<double>")
    got = {(r["band"], r["r"], r["c"]): r["value"] for r in grid.mosaic(table, 2, 3, 2, 4, 6, bands=2).collect()}
    assert got == {(b, i, j): z[i, j, b] for i in range(4) for j in range(6) for b in range(2)}


@pytest.mark.parametrize("size", [3, 6])
def test_tiles_of_a_wrong_size_are_refused(spark, size):
    table = spark.createDataFrame([(0, [1.0] * size)], "tile_id long, tile_values array<double>")
    with pytest.raises(Exception, match=f"{size} values, not 4"):
        grid.mosaic(table, 2, 2, 1, 2, 2).collect()


def test_crop_and_stride_match_slicing(spark):
    z = np.random.default_rng(1).random((17, 23))
    cells = raster(spark, z)
    cropped = grid.crop_border(cells, 2, 17, 23)
    assert np.array_equal(array_of(cropped, 13, 19, "elevation_m"), z[2:-2, 2:-2])
    strided = grid.stride(cropped, 3)
    assert np.array_equal(array_of(strided, 5, 7, "elevation_m"), z[2:-2, 2:-2][::3, ::3])


@pytest.mark.parametrize("rows,cols,step", [(12, 12, 3), (13, 11, 4), (5, 7, 2)])
def test_upsample_repeats_and_pads(spark, rows, cols, step):
    z = np.random.default_rng(2).random((rows, cols))
    coarse = z[::step, ::step]
    # One coarse row is missing on purpose, so the last one has to fill the ragged edge.
    coarse = coarse[: max(1, coarse.shape[0] - 1)]
    got = array_of(grid.upsample_nearest(raster(spark, coarse), step, rows, cols), rows, cols, "elevation_m")
    i = np.minimum(np.arange(rows) // step, coarse.shape[0] - 1)
    j = np.minimum(np.arange(cols) // step, coarse.shape[1] - 1)
    assert np.array_equal(got, coarse[np.ix_(i, j)])


def test_step_rounds_half_to_even():
    assert numeric.half_even_step(100, 40) == 2
    assert numeric.half_even_step(2148, 420) == 5
    assert numeric.half_even_step(10, 400) == 1


def test_labels_print_like_python(spark):
    rng = np.random.default_rng(3)
    numbers = np.concatenate(
        [
            rng.normal(size=300),
            rng.random(300) * 10.0 ** rng.integers(-2, 9, 300),
            np.arange(0, 4000) / 40.0,
            np.array([0.0, 0.005, 0.015, 0.025, 0.125, 0.375, 99.95, 99.5, 100.5, 101.5, 999.5, 1e3, 1e6, 1250.0, 1350.0]),
        ]
    )
    numbers = np.concatenate([numbers, -numbers[:700]])

    def python_label(v):
        size = abs(v)
        if size >= 1e6:
            return f"{v / 1e6:.1f}M"
        if size >= 1e3:
            return f"{v / 1e3:.1f}k"
        return f"{v:.0f}" if size >= 100 else f"{v:.1f}" if size >= 1 else f"{v:.2f}"

    df = spark.createDataFrame(pd.DataFrame({"v": numbers + 0.0}))
    for row in numeric.with_compact_labels(df, {"label": "v"}).collect():
        if row["v"] != 0:
            assert row["label"] == python_label(row["v"]), row


def test_percentiles_of_a_large_table_are_exact(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(6000) < 0.35, 7.0, np.round(rng.exponential(30, 6000), 1))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probabilities = [0.0, 0.01, 0.2, 0.5, 0.77, 0.995, 1.0]
    for bracket in (0, 40, 100_000):
        got = exact_percentiles(df, {"x": probabilities}, bracket)["x"]
        assert np.allclose(got, np.percentile(x, [100 * p for p in probabilities]), rtol=0, atol=1e-12)


def test_percentiles_take_a_fixed_number_of_jobs(spark):
    df = spark.range(20_000).select(*[((F.col("id") * k) % 9973 / 7).alias(f"c{k}") for k in (3, 5, 7, 11)], F.lit(None).cast("double").alias("none"))
    probabilities = [0.01, 0.02, 0.5, 0.99, 0.995]
    spark.sparkContext.setJobGroup("percentiles", "count jobs")
    got = exact_percentiles(df, {c: probabilities for c in df.columns})
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("percentiles")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = df.toPandas()
    assert all(np.allclose(got[c], np.percentile(want[c], [100 * p for p in probabilities])) for c in df.columns[:4])
    assert np.isnan(got["none"]).all()
    assert len(jobs) <= 6  # three queries; an aggregate may take a job per stage


def test_salted_lookup_equals_broadcast_lookup(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("left", "inner"):
        salted = lookup_join(left, right, ["k"], how)
        plain = lookup_join(left, right, ["k"], how, right_rows=40)
        assert sorted(map(tuple, salted.select("id", "k", "w").collect()), key=str) == sorted(
            map(tuple, plain.select("id", "k", "w").collect()), key=str
        )


def test_banded_median_carries_over_empty_bands(spark):
    z = np.array([[0.0, 0.5, 10.0, 9.9]])
    cells = raster(spark, z).withColumns({"red": F.lit(10) * F.col("c"), "green": F.lit(5), "blue": F.lit(7)})
    rows = layers.banded_median(cells, ["red", "green", "blue"], bands=5).orderBy("band").collect()
    assert [r["red"] for r in rows] == [5.0, 5.0, 5.0, 5.0, 25.0]
    assert [r["n_cells"] for r in rows] == [2, 0, 0, 0, 2]
    none_below = cells.withColumn("red", F.when(F.col("c") >= 2, F.col("red")))
    assert layers.banded_median(none_below, ["red"], bands=5).orderBy("band").first()["red"] == 40.0


def test_direction_convention(spark):
    codes = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "d8_code double")
    assert layers.direction_convention(codes([0, 1, 2, 4, 128, -1])).first()[0] == "esri"
    assert layers.direction_convention(codes([0, 1, 2, 3])).first()[0] == "sequential"
    legend = layers.direction_legend(codes([1, 3, 3, 0])).orderBy("code").collect()
    assert [(r["label"], r["n_cells"]) for r in legend][:3] == [("code 1", 1), ("code 2", 0), ("code 3", 2)]


def test_cyclic_layer_detects_radians(spark):
    radians = spark.createDataFrame([(0.0,), (3.141592653589793,), (-1.0,)], "a double")
    degrees = spark.createDataFrame([(0.0,), (180.0,), (-1.0,)], "a double")
    for df in (radians, degrees):
        assert [r["norm"] for r in layers.cyclic_layer(df, "a").collect()] == [0.0, 0.5, None]


def test_catalogue_leaves_out_layers_without_bands(spark):
    cells = raster(spark, np.arange(12.0).reshape(3, 4)).withColumns({"slope_deg": F.lit(5.0), "twi": F.col("r") * 1.0})
    nodes = spark.createDataFrame([(0, 7.25), (1, 1250.0)], "node_id long, precip_mm double")
    got = layers.layer_catalogue(cells, nodes).orderBy("display_order").collect()
    assert [r["layer"] for r in got] == ["slope", "twi", "precipitation"]
    assert (got[2]["min_label"], got[2]["max_label"]) == ("7.2 mm", "1.2k mm")


def test_percentiles_by_group_are_exact(spark):
    """Groups of one value, of equal values, of most rows; brackets large enough for one round, and so small that they are cut again."""
    rng = np.random.default_rng(3)
    values = {"big": rng.normal(size=30_000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]), "same": np.full(400, 2.5)}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("big", None), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probabilities = [0.0, 0.013, 0.5, 1.0]
    for bracket in (100_000, 3):
        got = {(r["g"], r["p"]): r["value"] for r in percentiles_by_group(df, "g", "x", probabilities, bracket).collect()}
        assert got == pytest.approx({(g, p): np.percentile(xs, 100 * p) for g, xs in values.items() for p in probabilities}, abs=1e-12)
