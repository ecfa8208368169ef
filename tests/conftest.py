import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")

from casemesh.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(4, "4g", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
