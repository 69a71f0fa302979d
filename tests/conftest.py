import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mailspark.session import build_session


# test modules build columns at import, which needs a session
SESSION = build_session("tests", "local[4]", 4)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    if not SESSION.conf.get("spark.checkpoint.dir", None):
        SESSION.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return SESSION


@pytest.fixture
def rows(spark):
    """Evaluate one column expression over a list of single values."""
    def run(values, expression, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in df.select(expression.alias("out"), "i").orderBy("i").collect()]
    return run
