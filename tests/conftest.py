import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyrewatch.session import local_session

    session = local_session("tests", 4, str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
