"""Session defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` (underscores for dots) goes on top. Sizes stay the cluster's."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a run's tables under ``spark.checkpoint.dir``, which all executors share; a session on one machine may do without."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/tessera/{name}-{uuid.uuid4().hex}"
