import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from wayline.session import local_session, ship_package

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
