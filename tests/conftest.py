import os
import struct

import numpy as np
import pytest

from voxledger.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(os.environ.get("TEST_CPUS", "8"), "tests")


@pytest.fixture(autouse=True)
def ordinary_groups(request):
    """Every test starts with the normal size of pieces."""
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").conf.unset("spark.voxledger.pieceRows")
    yield


@pytest.fixture
def hot(spark, ordinary_groups):
    """Small pieces, so that most groups have several."""
    spark.conf.set("spark.voxledger.pieceRows", "16")
    yield
    spark.conf.unset("spark.voxledger.pieceRows")


def wav_bytes(x, sr=16000, channels=1) -> bytes:
    body = np.clip(np.rint(np.asarray(x) * 32768), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack(
        "<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, sr, sr * 2 * channels,
        2 * channels, 16, b"data", len(body),
    )
    return head + body
