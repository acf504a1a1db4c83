import os

import pytest


@pytest.fixture(scope="session")
def spark():
    from affinia.session import local_session

    return local_session(cores="4", memory="4g", partitions=4)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
