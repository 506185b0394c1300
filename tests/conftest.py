import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pointproc.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


@pytest.fixture
def trains(spark):
    """Build a spike table from {channel: times} or {(recording, channel): times}."""

    def make(data, duration):
        rows = []
        for key, times in data.items():
            rec, ch = key if isinstance(key, tuple) else ("r", key)
            rows += [(rec, ch, int(t), int(duration)) for t in times]
        spikes = spark.createDataFrame(rows, "recording_id string, channel int, t_us bigint, duration_us bigint")
        used = spark.createDataFrame([((k if isinstance(k, tuple) else ("r", k)) + (int(duration),)) for k in data],
                                     "recording_id string, channel int, duration_us bigint")
        return spikes, used

    return make
