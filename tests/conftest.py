import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from keysieve.session import local_session

    session = local_session("8", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rules():
    from keysieve.sources.rulesets import default_rules

    return default_rules()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def lines_frame(spark):
    def make(lines, path="src/app.go"):
        rows = [(path, n, line) for n, line in enumerate(lines, 1)]
        return spark.createDataFrame(rows, "path string, line_no int, line string")

    return make
