import pytest

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4)
    yield session
    session.stop()
