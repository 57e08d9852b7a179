"""A session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidemark", master: str | None = None, **conf: object) -> SparkSession:
    """UTC, adaptive execution and skew joins on, batches of 1,000 rows to Python (long texts); anything else by keyword, dots written as double underscores."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, str(v))
    return b.getOrCreate()
