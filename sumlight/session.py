"""A session with the settings that the plans here expect, and the run's own settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.ignoreCorruptFiles": "false",
}


def session(name: str = "sumlight", **settings: str) -> SparkSession:
    """A session; settings by name with dots as double underscores, as in spark__master."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("__", "."): str(v) for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Config:
    """What a run may change; the environment's values come first."""

    results: str = field(default_factory=lambda: os.environ.get("RESULTS_PATH", "results"))
    dataset_size: int = field(default_factory=lambda: int(os.environ.get("DATASET_SIZE", "100000")))
    query_pool: int = field(default_factory=lambda: int(os.environ.get("NUM_QUERY_CANDIDATES", "1000")))
