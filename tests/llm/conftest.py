import pytest
from pyspark.sql import Row

from tests.conftest import SF

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, more=""):
    """documents from (doc_id, text, source) or (doc_id, text)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    if more:
        full = [(*r, "x") for r in full]
    return spark.createDataFrame(full, KINDS + (f", {more} string" if more else ""))


@pytest.fixture(scope="session")
def small():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


__all__ = ["Row", "frame", "rows_of"]
