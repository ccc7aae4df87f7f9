import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(os.path.dirname(HERE)), HERE]

from proofbox.session import ship_package  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def _package_on_workers(spark):
    ship_package(spark)
