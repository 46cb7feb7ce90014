import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_tables import TRICKY, table  # noqa: E402


@pytest.fixture(scope="module")
def tricky(spark):
    return table(spark, TRICKY).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])
