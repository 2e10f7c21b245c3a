import os

import pytest

from terrane.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", int(os.environ.get("TERRANE_PARTITIONS", "4")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
