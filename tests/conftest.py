from __future__ import annotations

import pytest

from quillspark.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g", name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
