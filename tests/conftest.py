import pytest

from pulseloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", partitions=4)
    yield session
    session.stop()
