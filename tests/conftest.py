import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sylvan.session import build_session
    s = build_session("local[4]", 4, extra={"spark.driver.memory": "8g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from places import SF_SMALL
    from tools.oracle_check import duck as make
    return make(SF_SMALL)
