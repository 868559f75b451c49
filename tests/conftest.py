import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from check_queries import local_session

    session = local_session("4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
