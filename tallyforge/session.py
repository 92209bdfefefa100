"""The session settings this library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # filters on a mailbox's days and labels reach its query
    "spark.sql.python.filterPushdown.enabled": "true",
    # bodies and attachments are large: fewer rows to an Arrow batch keep Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def session(app: str = "tallyforge", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
