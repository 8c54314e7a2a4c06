import pytest


@pytest.fixture(scope="session", autouse=True)
def released(spark):
    """Tables in the shared folder go when the tests are over."""
    yield
    from maskwell.llm import common

    common.release(spark)
