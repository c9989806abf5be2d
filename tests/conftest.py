import pytest

from skerry.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 8, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield s
