"""Delivery records (record_id, data) from any file source, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglake import schema as S


def read_envelopes(spark: SparkSession, path: str, fmt: str = "json",
                   streaming: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """Read delivery records with a fixed schema; a stream when asked."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(S.DELIVERY_RECORD)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.format(fmt).load(path)


def write_envelopes(records: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    records.select("record_id", "data").write.mode(mode).format(fmt).save(path)
