import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_rows import ODD, SMALL, documents  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from errorlens.session import local_session
    s = local_session("*", 8, app_name="errorlens-llm-tests")
    yield s


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, []).cache()


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()
