import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from markwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("markwise-tests", cores=os.environ.get("TEST_CPUS", "8"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
