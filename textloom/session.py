"""Session settings that suit the engine's plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling; ``conf`` adds or overrides settings."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    usual = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (usual | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
