import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hemicycle.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    """Small partitions are kept apart, so running totals cross slices."""
    return local_session(4, "4g", 4, {"spark.sql.adaptive.coalescePartitions.enabled": "false"})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
