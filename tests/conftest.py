import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from candela.session import build_session

    session = build_session("tests", cores=4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()
