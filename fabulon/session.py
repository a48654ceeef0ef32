"""A Spark session with the settings this engine is written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """The active or a new session: adaptive execution on, UTC, Arrow for what crosses to Python.

    Partition counts and memory are left to the cluster's own settings; adaptive execution
    coalesces small partitions and splits skewed ones.
    """
    b = SparkSession.builder
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df without lineage, through the checkpoint folder that the session names; a local session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp("checkpoints"))
    return df.checkpoint(eager=True)
