import pytest

from flowcascade.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", app="tests", shuffle_partitions=4,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stages"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
