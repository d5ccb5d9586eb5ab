import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from clipledger.session import build_session

    s = build_session("8")
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture
def hot(spark):
    """Treat every group of more than 20 rows as hot."""
    from clipledger.session import HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, "20")
    yield
    spark.conf.unset(HOT_ROWS_CONF)
