import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from chronolap import session

    s = session.session(4, 4, "tests")
    session.ship(s)
    s.sparkContext.setLogLevel("ERROR")
    return s
