import pytest

from tidepanel.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4, {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
