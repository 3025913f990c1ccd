import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("QG_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quillgrain.session import build_session

    s = build_session("tests", shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("test tables are not here")
    return DATA


@pytest.fixture
def value(spark):
    """Value of a column expression over one row of named values."""

    def run(make, schema, *row):
        return spark.createDataFrame([row], schema).select(make).first()[0]

    return run
