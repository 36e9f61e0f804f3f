"""The shared work folder of the cluster, for cut lineage and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def work_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir. Where it is unset, a temporary one in local mode; elsewhere an error, as executors share no such folder."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getConf().get(SETTING, None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="talusgrid-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps iterative plans short."""
    work_folder(df.sparkSession)
    return df.checkpoint()
