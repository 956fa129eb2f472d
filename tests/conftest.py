import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from metricwatch.session import local_session

    session = local_session("tests", "8", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """Points from (series, ts, value) tuples."""
    def make(rows):
        return spark.createDataFrame([(s, int(t), None if v is None else float(v)) for s, t, v in rows],
                                     "series_id string, ts long, value double")

    return make
