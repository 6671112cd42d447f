"""Sessions: the builder for local use, and what every query expects of a session."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, few shuffle partitions; aggregates of many columns are compiled too."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegauge")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.codegen.maxFields", "2000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return reachable(spark)


def reachable(spark: SparkSession) -> SparkSession:
    """Puts this checkout on the module path of Python workers started from now on.

    For checkouts that are imported from a folder; an installed package doesn't need it.
    """
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    return spark
