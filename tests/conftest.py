import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parcelweave.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("parcelweave-tests")
    yield session
    session.stop()
