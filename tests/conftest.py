import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from noticeflow.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("noticeflow-tests", "local[4]", 4)
    yield session
    session.stop()
