import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vacantia.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__ui__enabled="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="vacantia-"), spark__sql__shuffle__partitions="2",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def rows(spark):
    """Build a DataFrame from dictionaries with a schema text."""
    def make(schema, *records):
        return spark.createDataFrame([tuple(r) for r in records], schema)
    return make
