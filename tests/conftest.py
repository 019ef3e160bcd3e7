import pytest

from sightgrid.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "sightgrid-tests", **{"spark.sql.shuffle.partitions": "4",
                                                             "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
