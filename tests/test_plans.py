"""Plans stay in proportion to the tables they read: no operator multiplies the scans of its input without end."""

import re

import pytest

from tests.conftest import SF
from voxledger.catalog import load

REG = load()
MOST_SCANS = 60


@pytest.mark.parametrize("name", ["pre12_reject_routing", "rep3_observation", "src7_splice", "frm6_onsets", "syn13_interpretation", "scan_suspect_regions", "cmp5_20_rhythm_score"])
def test_scans(spark, name):
    plan = REG.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) <= MOST_SCANS
