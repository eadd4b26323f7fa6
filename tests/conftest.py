import pytest

from trailmix.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4)
