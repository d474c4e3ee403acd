import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, f"{ROOT}/tests", os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions=4, spark__ui__enabled="false", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
