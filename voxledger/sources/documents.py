"""Result documents as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object per line, one file per partition."""
    df.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", str(multi_line).lower())
    return (reader.schema(schema) if schema is not None else reader).json(path)
