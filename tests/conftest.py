import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.runtime import release, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)
    s.stop()


@pytest.fixture
def rows():
    """A set of a DataFrame's rows as tuples."""
    return lambda df: {tuple(r) for r in df.collect()}
