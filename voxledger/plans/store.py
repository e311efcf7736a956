"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from voxledger.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: later steps start from files, not from a recomputation.

    Used where several steps read the outcome of a costly one; the files outlive
    any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
