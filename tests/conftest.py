import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from cipherledger.session import local_session
    s = local_session("4", "tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
