import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
