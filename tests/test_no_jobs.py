"""Nothing but file footers is read while a query is built."""

import pytest

from tests.conftest import SF
from voxledger.catalog import load

REG = load()


@pytest.mark.parametrize("name", [n for n in REG.QUERIES if n != "src9_document_roundtrip"])
def test_building_runs_no_job(spark, name):
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup(f"build {name}", name)
    try:
        REG.QUERIES[name](spark, SF)
        jobs = tracker.getJobIdsForGroup(f"build {name}")
        stages = [tracker.getStageInfo(s) for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds]
        assert all(s is None or s.name.startswith("parquet") for s in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
