import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from civicframe.session import build_session  # noqa: E402
from civicframe.sources.local import small_frame  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    return lambda schema, *rows: small_frame(spark, list(rows), schema)


def rows(df, *order):
    """Rows as a list of tuples, sorted."""
    got = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(got, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]
