"""A session for all tests."""

import pytest

from prosemill.session import local


@pytest.fixture(scope="session")
def spark():
    s = local("4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
