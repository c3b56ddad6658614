import pytest

from latewin import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        app="latewin-tests",
        shuffle_partitions=4,
        extra={"spark.driver.memory": "8g", "spark.sql.ansi.enabled": "true"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
