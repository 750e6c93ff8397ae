from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

HOME = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = f"{HOME}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sloscope.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session("tests", cores=4, **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
