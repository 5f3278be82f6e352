import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ebbtide.session import build_session, clear_stages  # noqa: E402

TEST_DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[*]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('stage')}",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_stages(session)
    session.stop()
