"""One local session for all tests."""

from __future__ import annotations

import pytest

from syncwright.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared, "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
