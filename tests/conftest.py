import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from barspark.session import cleanup, get_spark

    s = get_spark("tests", 8)
    yield s
    cleanup(s)
    s.stop()
