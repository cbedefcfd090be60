import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foreband.core import ship  # noqa: E402
from foreband.session import local_session  # noqa: E402

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def root():
    return ROOT
