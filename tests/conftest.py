import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from merloom.session import local_session

    s = local_session("4", 4, **{"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("MERLOOM_TEST_DATA", "/root/testdata/sf0.001")
