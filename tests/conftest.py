import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from fraudwatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "12g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over a single row of named values."""

    def run(expression, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k)
                                      for k, v in values.items()])
        return row.select(expression.alias("out")).first()["out"]

    return run


def tuples(df, *order):
    rows = [tuple(r) for r in df.collect()]
    return sorted(rows, key=repr)
