import pytest

from skeinflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()
