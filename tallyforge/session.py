"""A session for the engine. On a cluster the caller's own session is used."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyforge", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
