import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])


@pytest.fixture(scope="session")
def spark():
    from tallyscan.session import local_session

    session = local_session(8, "tests", "8g")
    yield session
    session.stop()
