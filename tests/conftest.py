import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from drainwatch.session import build_session, shared_dir

    session = build_session("local[4]", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    yield session
    session.stop()
