import tempfile

import pytest

from tabweave import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4, **{
        "spark.driver.host": "127.0.0.1", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tabweave-tests-"), "spark.sql.warehouse.dir": tempfile.mkdtemp()})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
