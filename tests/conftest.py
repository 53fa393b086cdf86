import pytest

from quarrylens.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", shuffle_partitions=4)
    yield session
    session.stop()
