from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from histospark.session import get_session
    s = get_session(cpus="*", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def hist(spark):
    from histospark.context import Historian
    return Historian.for_fixtures(spark, SF_SMALL)
