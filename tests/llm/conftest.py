import pytest

from tests.conftest import SF


@pytest.fixture(scope="session")
def sf():
    return SF
