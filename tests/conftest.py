import pytest

from loomline.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
