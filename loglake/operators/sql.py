"""Ad-hoc SQL over the ``logs`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, logs: DataFrame, sql: str, args: dict | None = None,
            view: str = "logs") -> DataFrame:
    """Run ``sql`` with ``logs`` bound as a temporary view.

    Values go in as named parameters (``:name``), never spliced into the text,
    so quotes in them are harmless.
    """
    logs.createOrReplaceTempView(view)
    return spark.sql(sql, args=args or None)
