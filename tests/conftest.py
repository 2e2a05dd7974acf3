import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from notalake.session import local_session, prepare

    session = prepare(local_session("8", 8))
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluates a column expression over literal inputs: value(fn, 'a', 'b') -> results in order."""
    from pyspark.sql import functions as F

    def run(fn, *inputs):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
        return [r["out"] for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]

    return run
