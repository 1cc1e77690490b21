import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import messy  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return messy.table(spark).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return messy.empty(spark)


@pytest.fixture(scope="session")
def small():
    return SMALL
