import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siltmill.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", os.environ.get("TEST_CPUS", "4"), **{"spark.sql.shuffle.partitions": "4"})
