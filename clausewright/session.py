"""SparkSession factory with the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "clausewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI mode, AQE (coalescing and skew joins) and Arrow.

    ``master`` is left to the cluster's submit options when it is None and
    one is already configured; otherwise local[*] is used. Shuffle partitions
    are an upper bound: AQE merges small ones. SPARK_CHECKPOINT_DIR names the
    shared folder of intermediate tables unless a setting does.
    """
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.checkpoint.dir": os.environ.get("SPARK_CHECKPOINT_DIR", ""),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map={k: v for k, v in settings.items() if v}).getOrCreate()
