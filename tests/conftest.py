import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402,F401
from check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session()
    made.conf.set("spark.sql.shuffle.partitions", "4")
    return made
