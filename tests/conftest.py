import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")  # small matrices: threads cost more than they give

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kinspark.session import local_session

    session = local_session("4", 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    return session
