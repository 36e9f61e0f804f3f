"""Playback frames: interpolation in time, readouts, quantising and packing."""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.functions.colour import byte_level
from talusgrid.functions.numeric import lit

FS_TOP = 3.0
DEPTH_TOP = 10.0
EROSION_TOP = 3.0
NODES_PER_PACK = 65_536


def last_hour(node_hours: DataFrame) -> Column:
    """Last hour of a table as a scalar subquery."""
    return node_hours.agg(F.max("hr")).scalar()


def frame_at(node_hours: DataFrame, hour: float) -> DataFrame:
    """FS and depth at a fractional hour, bounded by the hours of the table.

    Only the two hours around it are read (a partition filter on an hour-partitioned table), and
    a conditional aggregate brings them together without a window sort.
    """
    h0, last = max(0, math.floor(hour)), last_hour(node_hours)
    part = max(0.0, min(1.0, hour - h0))
    two = node_hours.where((F.col("hr") == F.least(F.lit(h0), last)) | (F.col("hr") == F.least(F.lit(h0 + 1), last)))
    at = lambda name, h: F.max(F.when(F.col("hr") == F.least(F.lit(h), last), F.col(name))).alias(f"{name}_{h - h0}")
    both = two.groupBy("node_id").agg(*[at(name, h) for name in ("fs", "depth_m") for h in (h0, h0 + 1)])

    def mixed(name: str) -> Column:
        a, b = F.col(f"{name}_0"), F.col(f"{name}_1")
        return F.when(a == b, a).otherwise(a * (1 - part) + b * part).alias(name)

    return both.select("node_id", mixed("fs"), mixed("depth_m"))


def readouts(failed: DataFrame, rain: DataFrame, times: list[float]) -> DataFrame:
    """Failed share and rain shown at each time: the nearest hour, halves going up.

    failed(hr, failed_frac) and rain(hr, rain_mm) have one row per hour.
    """
    last = last_hour(failed)
    per_hour = failed.join(rain, "hr")
    shown = lambda t: F.least(F.lit(math.floor(t + 0.5)), last)
    wanted = F.array(*[F.struct(F.lit(float(t)).alias("t"), shown(t).alias("shown_hr")) for t in times])
    return (
        per_hour.select("*", F.inline(wanted))
        .where(F.col("hr") == F.col("shown_hr"))
        .select("t", "shown_hr", "failed_frac", "rain_mm")
    )


def quantised(node_hours: DataFrame, fs_top: float = FS_TOP, depth_top: float = DEPTH_TOP) -> DataFrame:
    return node_hours.select(
        "node_id",
        "hr",
        byte_level(F.col("fs"), fs_top).alias("fs_q"),
        byte_level(F.col("depth_m"), depth_top).alias("depth_q"),
    )


def _packer(key: list[str], levels: dict[str, int]):
    """Function that turns a group's byte levels into base64 text in node order; a missing level has the given value."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node_id", kind="stable")
        values = np.stack([rows[c].fillna(v).to_numpy(dtype=np.uint8) for c, v in levels.items()], axis=1)
        text = base64.b64encode(values.tobytes()).decode()
        return pd.DataFrame({**{k: rows[k].iloc[:1] for k in key}, "n_nodes": [len(rows)], "b64": [text]})

    return pack


def pack_frames(levels: DataFrame, nodes_per_pack: int = NODES_PER_PACK) -> DataFrame:
    """Per hour and block of nodes: FS and depth bytes of consecutive nodes as base64 text.

    A block has at most nodes_per_pack nodes, so rows and groups stay small at any number of nodes; blocks in order make
    up the frame of an hour. An unknown FS is drawn as stable.
    """
    block = F.floor(F.col("node_id") / nodes_per_pack).cast("long")
    rows = levels.select("hr", block.alias("block"), "node_id", *[F.col(c).cast("short").alias(c) for c in ("fs_q", "depth_q")])
    return rows.groupBy("hr", "block").applyInPandas(_packer(["hr", "block"], {"fs_q": 255, "depth_q": 0}), "hr int, block long, n_nodes long, b64 string")


def pack_metadata(node_hours: DataFrame, rows, cols) -> DataFrame:
    """What is needed to decode the packs: hours, nodes, grid size and the values that the top byte stands for."""
    shape = node_hours.agg(F.countDistinct("hr").alias("n_hours"), F.countDistinct("node_id").alias("n_nodes"))
    return shape.select(
        "n_hours", "n_nodes", lit(rows).alias("grid_rows"), lit(cols).alias("grid_cols"),
        F.lit(FS_TOP).alias("fs_top"), F.lit(DEPTH_TOP).alias("depth_top"), F.lit(EROSION_TOP).alias("erosion_top"),
    )


def pack_erosion(
    erosion: DataFrame, erosion_top: float = EROSION_TOP, nodes_per_pack: int = NODES_PER_PACK
) -> DataFrame:
    """erosion(node_id, erosion_m) -> one byte per node, packed like the frames."""
    block = F.floor(F.col("node_id") / nodes_per_pack).cast("long")
    rows = erosion.select(block.alias("block"), "node_id", byte_level(F.col("erosion_m"), erosion_top).cast("short").alias("q"))
    return rows.groupBy("block").applyInPandas(_packer(["block"], {"q": 0}), "block long, n_nodes long, b64 string")
