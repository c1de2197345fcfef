"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

DEFAULTS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC"}


def session(name: str = "tamis", **more: str) -> SparkSession:
    """A session with the engine's defaults: adaptive plans, case-sensitive names, UTC."""
    return SparkSession.builder.appName(name).config(map=DEFAULTS | more).getOrCreate()


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, unless they do already."""
    sc = spark.sparkContext
    have = sc.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
