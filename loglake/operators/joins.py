"""Small driver-side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_table(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A small driver-side table shipped to Spark as one Arrow batch.

    Built through pandas + Arrow it plans as a local relation: reading it
    needs no Python worker and no job, and Spark knows its size. Columns are kept as Python
    objects so nulls stay nulls.
    """
    import pandas as pd

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = [f.name for f in schema.fields]
    pdf = pd.DataFrame.from_records([tuple(r) for r in rows], columns=names)
    pdf = pdf.astype(object).where(pdf.notna(), None) if len(pdf) else pdf
    return spark.createDataFrame(pdf, schema)
