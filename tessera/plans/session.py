"""Session settings and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators count on; everything else is the cluster's choice.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tessera", **more: str) -> SparkSession:
    """The active session, or a new one with the settings above."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which all executors share; a folder of our own in local mode where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        live = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = live.get() if live.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Tables:
    """Parquet tables of a folder as attributes: ``Tables(spark, dir).events``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
