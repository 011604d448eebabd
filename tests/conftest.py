import pytest

from tablejury.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=8, shuffle_partitions=8)
    yield session
    session.stop()
