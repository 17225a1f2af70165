"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessera import runtime  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = runtime.session("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    runtime.ship(s)
    yield s
    s.stop()
