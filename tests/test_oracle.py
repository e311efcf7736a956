"""Every query with SQL agrees with it, also when its groups are taken for hot ones."""

import pytest

from tests.compare import diff, duck
from tests.conftest import SF
from voxledger.catalog import load

REG = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(REG.QUERIES))
def test_query(spark, con, name):
    if name in REG.SQL:
        assert diff(spark, con, REG.QUERIES[name], REG.SQL[name], SF) is None
    else:
        assert REG.QUERIES[name](spark, SF).count() > 0


# one query per segmented operation: index, previous, running sum and maximum, totals, attach, quantiles
HOT = [
    "scan_suspect_regions", "syn12_splice_only", "syn14_timeline_axis", "pre5_energy_profile", "pre7_active_frames",
    "pre9_resequence", "win1_sliding_windows", "ind6_mfcc_baseline", "ind7_cross_window_distance",
    "ind8_9_10_spectral_score", "pro1_pitch_profile", "pro2_pitch_contour", "pro3_formant_profile", "pro6_interior_pauses",
    "pro10_energy_dynamics", "frm6_onsets", "eva2_error_curve", "eva4_operating_points", "str1_sessions", "src7_splice",
]


@pytest.mark.parametrize("name", HOT)
def test_hot_groups(spark, con, hot, name):
    assert diff(spark, con, REG.QUERIES[name], REG.SQL[name], SF) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
