"""A session with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "luxflow", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling and coalescing; conf overrides, dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": os.environ.get("LUXFLOW_UI", "false"),
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
