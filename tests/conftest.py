import pytest

from holdfast.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g", app="holdfast-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
