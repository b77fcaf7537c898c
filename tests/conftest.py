import pytest

from tessella.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
