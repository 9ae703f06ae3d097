import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from newsloom import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.build("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__default__parallelism="4", spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame with the columns in the order given, even if `rows` is empty."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
