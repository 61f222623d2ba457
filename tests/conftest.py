import pytest

from millrace.session import prepare
from tests.session import new_session


@pytest.fixture(scope="session")
def spark():
    session = prepare(new_session())
    yield session
    session.stop()
