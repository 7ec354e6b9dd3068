import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from livetick.session import build_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("livetick-tests", "local[8]", 4, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture
def make_events(spark):
    """Events from (ms, cpu, requests, host) tuples in arrival order."""
    def make(rows):
        numbered = [(i, ms * 1_000, host, float(cpu), requests) for i, (ms, cpu, requests, host) in enumerate(rows)]
        df = spark.createDataFrame(numbered, "seq bigint, ts_us bigint, host string, cpu double, requests bigint")
        return df.selectExpr("seq", "timestamp_micros(ts_us) AS ts", "ts_us", "host", "cpu", "requests")
    return make
