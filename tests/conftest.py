import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from symtrail.session import build

    session = build("symtrail-tests", cores=8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def shop_files(spark):
    from tests.projects import as_files

    return as_files(spark)
