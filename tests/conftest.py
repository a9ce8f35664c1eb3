import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from hoprank.session import get_spark
    s = get_spark("tests", conf={"spark.sql.shuffle.partitions": "8"})
    yield s


@pytest.fixture(scope="session")
def ws(spark):
    from hoprank.plans.workspace import Workspace
    return Workspace.load(spark, SF_SMALL)
