import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talusgrid.functions import numeric, physics
from talusgrid.functions import soil as soil_fn
from talusgrid.operators import stability


def ierfc(x):
    return math.exp(-x * x) / math.sqrt(math.pi) - x * math.erfc(x)


def direct_psi(z, hour, slope, ks, d0, rain, wt, flux=0.02):
    """Superposition of switched-on and switched-off steps, evaluated at the end of the hour."""
    cos2 = math.cos(slope) ** 2
    d1 = d0 / max(cos2, 1e-6)
    psi = (cos2 - flux * ks / max(ks, 1e-12)) * (z - wt)
    for n, intensity in enumerate(rain):
        for start, sign in ((n, 1), (n + 1, -1)):
            tau = 3600.0 * (hour + 1 - start)
            if tau > 0:
                reach = math.sqrt(d1 * tau)
                psi += sign * 2 * intensity / max(ks, 1e-12) * reach * ierfc(z / (2 * math.sqrt(max(d1 * tau, 1e-12))))
    return min(psi, z)


def demo_nodes(spark):
    slopes = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 90.0]
    data = pd.DataFrame({"node_id": range(len(slopes)), "slope_deg": slopes})
    return spark.createDataFrame(data).withColumns(
        {
            "ksat_m_s": F.lit(2e-6),
            "diffusivity_m2_s": F.lit(1e-5),
            "precip_mm": F.lit(150.0),
            "cohesion_kpa": F.lit(10.0),
            "friction_deg": F.lit(27.0),
            "unit_weight": F.lit(18.0),
        }
    )


def test_pressure_follows_the_published_superposition(spark):
    shares = physics.storm_shares(14.0, 2.5)
    weights = [math.exp(-0.5 * ((h - 14) / 2.5) ** 2) for h in range(24)]
    rain = [0.150 * w / sum(weights) / 3600 for w in weights]
    rows = stability.stability_by_hour(demo_nodes(spark), shares).collect()
    assert len(rows) == 7 * 24
    for r in rows:
        slope = math.radians(r["slope_deg"])
        psi = direct_psi(1.5, r["hr"], slope, 2e-6, 1e-5, rain, 2.0)
        assert r["psi"] == pytest.approx(psi, abs=5e-6)
        assert r["psi"] <= 1.5 and 0 <= r["fs"] <= 5


def test_unknown_soil_gives_null_and_never_fails(spark):
    nodes = demo_nodes(spark).withColumn("ksat_m_s", F.lit(None).cast("double"))
    rows = stability.stability_by_hour(nodes, physics.storm_shares()).select("psi", "fs", physics.failing(F.col("fs")).alias("x"))
    assert {tuple(r) for r in rows.collect()} == {(None, None, False)}


def test_the_arrow_function_runs_once(spark):
    plan = stability.stability_by_hour(demo_nodes(spark), physics.storm_shares()).where("fs < 1")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and "Exchange" not in text


def test_ierfc_is_accurate(spark):
    x = np.arange(0, 1201) / 100
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = df.select(numeric.ierfc(F.col("x")).alias("y")).toPandas()["y"].to_numpy()
    want = np.array([ierfc(v) for v in x])
    assert np.max(np.abs(got - want)) < 3e-8
    assert np.allclose(got, numeric.ierfc_array(x), rtol=0, atol=1e-15)


def test_storm_shares_add_up(spark):
    storms = spark.createDataFrame([("a", 14.0, 2.8), ("b", 3.0, 1.0)], "storm_id string, peak double, width double")
    out = stability.storm_profile(storms).groupBy("storm_id").agg(F.sum("share").alias("s"), F.count("*").alias("n"))
    assert all(r["s"] == pytest.approx(1) and r["n"] == 24 for r in out.collect())


@pytest.mark.parametrize(
    "sand,silt,clay,want",
    [
        (90, 5, 5, "sand"),
        (75, 15, 10, "sandy_loam"),
        (10, 85, 5, "silt_loam"),
        (10, 60, 30, "clay_loam"),
        (0, 82, 28, "silt"),
        (20, 30, 50, "clay"),
        (40, 40, 20, "loam"),
        (60, 10, 30, "loam"),
    ],
)
def test_texture_rules(spark, sand, silt, clay, want):
    df = spark.createDataFrame([(float(sand), float(silt), float(clay))], "sand double, silt double, clay double")
    got = df.select(soil_fn.texture_class(F.col("sand"), F.col("silt"), F.col("clay"))).first()[0]
    assert got == want


def test_unknown_texture_has_no_strength(spark):
    df = spark.createDataFrame([("clay",), ("gravel",), (None,)], "texture string")
    rows = soil_fn.with_strength(df).collect()
    assert [(r["cohesion_kpa"], r["friction_deg"]) for r in rows] == [(20.0, 20.0), (0.0, 0.0), (0.0, 0.0)]


def storm_ready(spark, n=400):
    k = F.col("id")
    return spark.range(n).select(
        k.alias("node_id"), (k % 46 + 1e0).alias("slope_deg"), (F.lit(1e-6) * (1 + k % 7)).alias("ksat_m_s"), F.when(k % 50 != 0, F.lit(1e-5) * (1 + k % 5)).alias("diffusivity_m2_s"),
        (F.lit(50e0) + 7 * (k % 60)).alias("precip_mm"), (F.lit(1e0) + k % 9).alias("cohesion_kpa"), (F.lit(20e0) + k % 14).alias("friction_deg"), (F.lit(16e0) + k % 5).alias("unit_weight"),
    )


def test_onset_from_the_array_is_the_onset_of_node_hours(spark):
    from talusgrid.operators import runout

    shares = physics.storm_shares()
    want = {r["node_id"]: r["onset_hr"] for r in runout.failure_onset(stability.stability_by_hour(storm_ready(spark), shares)).collect()}
    onset = stability.onset_by_node(storm_ready(spark), shares)
    got = {r["node_id"]: r["onset_hr"] for r in onset.collect() if r["onset_hr"] is not None}
    assert got == want and 0 < len(want) < 400 and len(set(want.values())) > 3
    plan = onset._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_a_filter_on_the_onset_runs_the_series_once(spark):
    """The series of a node is made once and its hours are not looked at in interpreted expressions."""
    nodes = storm_ready(spark).union(storm_ready(spark, 3).withColumns({"ksat_m_s": F.lit(None).cast("double"), "node_id": F.col("node_id") + 1000}))
    found = stability.onset_by_node(nodes, physics.storm_shares()).where("onset_hr is not null").select("node_id", "onset_hr")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
    fails = stability.stability_by_hour(nodes, physics.storm_shares()).where("fs < 1").groupBy("node_id").agg(F.min("hr").alias("onset_hr"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, fails.collect())) != []


def test_releases_stay_one_pass_under_the_deposits(spark):
    """The filters that the deposits' join puts on the releases do not run the series once more."""
    from talusgrid.operators import drainage
    from talusgrid.plans import simulation

    ready = storm_ready(spark).withColumn("has_soil", F.col("node_id") % 3 > 0)
    reach = spark.range(400).select(F.col("id").alias("node_id"), (F.col("id") % 5).alias("terminal_id"))
    released = simulation.storm_releases(ready, physics.storm_shares())
    landed = drainage.deposits(released, reach)
    plan = landed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
    failed = {r["node_id"] for r in simulation.simulate(ready, physics.storm_shares()).where("fs < 1").collect()}
    assert {(r["terminal_id"], r["n_releases"]) for r in landed.collect()} == {(t, n) for t in range(5) if (n := sum(k % 5 == t for k in failed))}


def test_a_storm_moves_only_what_it_reads(spark):
    """Columns that the storm does not read do not go to the soil with the nodes, and its results are the same."""
    from talusgrid.plans import simulation

    k = F.col("id")
    nodes = spark.range(300).select(
        k.alias("node_id"), (k % 46 + 1e0).alias("slope_deg"), (k % 20 * 0.4e0).alias("u"), (k % 17 * 0.5e0).alias("v"),
        (k % 4 * 1e0).alias("rain_u"), (k % 3 * 1e0).alias("rain_v"), F.lit("x").alias("not_read"),
    )
    soil = spark.range(81).select((k / 9).cast("int").alias("lr"), (k % 9).cast("int").alias("lc"), (F.lit(100e0) + k).alias("sand_gkg"), (k * 2e0).alias("clay_gkg"), F.lit(120e0).alias("bdod_cgcm3"))
    rain = spark.range(25).select((k / 5).cast("int").alias("rr"), (k % 5).cast("int").alias("cc"), (k * 20e0).alias("precip_mm"))
    shares = physics.storm_shares()
    lean, whole = (simulation.storm_releases(simulation.storm_nodes(nodes, soil, rain, 5, 5, carry), shares) for carry in (simulation.STORM_COLUMNS, None))
    plan = lean._jdf.queryExecution().executedPlan().toString()
    assert "not_read" not in plan and "rain_u" not in plan[plan.index("MapInArrow") :].split("Sort")[0]
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, whole.collect())) != []
