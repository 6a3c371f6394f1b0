"""One local session for all tests; the repository is on the workers' path."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lipika.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
