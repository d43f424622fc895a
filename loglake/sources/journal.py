"""Move journals: what a job means to do with each file, and how far it is.

A journal is a folder of its own. Its ``files`` table has one row a file, written
before anything is touched; every step appends the paths it has done to ``states``
as the output of the job that does it, so a step that died has noted nothing. A
later run goes on from the journal: it does not list or plan again.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.session import create_text, delete_path, list_names, path_exists, read_text, write_text

PLANNED, COPIED, DELETED = "planned", "copied", "deleted"
_STATES = "path string, state string"


class Journal:
    """``files``: at least the column ``path``. ``about``: a short text kept with them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def begin(cls, folder: str, files: DataFrame, about: str = "") -> Journal:
        """Write down what is to be done. Only a journal whose plan is whole counts as begun."""
        spark = files.sparkSession
        journal = cls(spark, f"{folder}/{time.time_ns()}-{uuid.uuid4().hex[:8]}")
        files.write.parquet(f"{journal.path}/files")
        write_text(spark, f"{journal.path}/BEGUN", about or "-")
        return journal

    @classmethod
    def unfinished(cls, spark: SparkSession, folder: str) -> list[Journal]:
        """Begun and not ended, oldest first."""
        found = [cls(spark, f"{folder}/{name}") for name in list_names(spark, folder)]
        return [j for j in found if path_exists(spark, f"{j.path}/BEGUN") and not path_exists(spark, f"{j.path}/ENDED")]

    @property
    def about(self) -> str | None:
        return read_text(self.spark, f"{self.path}/BEGUN")

    def planned(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    def files(self) -> DataFrame:
        """The files with their ``state``."""
        if not path_exists(self.spark, f"{self.path}/states"):
            return self.planned().withColumn("state", F.lit(PLANNED))
        states = (self.spark.read.schema(_STATES).parquet(f"{self.path}/states")
                  .groupBy("path").agg(F.max(F.when(F.col("state") == DELETED, 2).otherwise(1)).alias("_step")))
        return (self.planned().join(states, "path", "left")
                .withColumn("state", F.when(F.col("_step") == 2, DELETED).when(F.col("_step") == 1, COPIED).otherwise(PLANNED))
                .drop("_step"))

    def note(self, done: DataFrame, state: str) -> None:
        """Run a step and note its files (column ``path``) together, when it is whole."""
        done.select("path", F.lit(state).alias("state")).write.mode("append").parquet(f"{self.path}/states")

    def end(self) -> None:
        write_text(self.spark, f"{self.path}/ENDED", "-")


class Lease:
    """One holder at a time, by a file that names it and when it last said so.

    A holder that has been silent for ``seconds`` is taken to be dead.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float):
        self.spark, self.path, self.seconds, self.name = spark, path, seconds, uuid.uuid4().hex

    def _text(self) -> str:
        return f"{self.name} {time.time()}"

    def take(self) -> None:
        if create_text(self.spark, self.path, self._text()):
            return
        name, _, said = (read_text(self.spark, self.path) or "").partition(" ")
        if name and time.time() - float(said) < self.seconds:
            raise RuntimeError(f"another run holds {self.path}; it is taken over after {self.seconds:.0f} s of silence")
        delete_path(self.spark, self.path)
        if not create_text(self.spark, self.path, self._text()):
            raise RuntimeError(f"another run took {self.path} over")

    def renew(self) -> None:
        """Say so again; fails if another run has taken over."""
        if (read_text(self.spark, self.path) or "").partition(" ")[0] != self.name:
            raise RuntimeError(f"another run has taken {self.path} over")
        write_text(self.spark, self.path, self._text())

    def give_up(self) -> None:
        delete_path(self.spark, self.path)
