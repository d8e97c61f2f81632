import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hirelens.session import get_session
    s = get_session("tests", 4, shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
