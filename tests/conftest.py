import pytest

from tests.session import spark_session


@pytest.fixture(scope="session")
def spark():
    return spark_session()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
