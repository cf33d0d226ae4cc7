import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "ledgerloom-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bank(spark):
    """The operational tables with all transactions."""
    import fixtures

    return fixtures.bank(spark)


@pytest.fixture(scope="session")
def first_day(spark):
    """The operational tables with the transactions of the first day."""
    import fixtures

    return fixtures.bank(spark, fixtures.FIRST_DAY)
