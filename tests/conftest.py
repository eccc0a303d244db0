import os
import tempfile
from pathlib import Path

import pytest

from conforank.storage import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # Stand-in toolkits live in this folder; executors import them from it.
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(Path(__file__).parent), os.environ.get("PYTHONPATH")]))
    session = build_session("8", "conforank-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="conforank-tests-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
