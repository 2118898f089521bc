"""Stored tables: JSON and parquet stores, feedback and prediction sinks."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from fraudwatch import schemas


def read_store(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """A JSON store, or no rows when it does not exist yet.

    ``multi_line`` reads documents that span lines; one record per line splits better.
    """
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_store(df: DataFrame, path: str) -> None:
    """Replace a store.  Never pass a frame that reads from the same path."""
    df.write.mode("overwrite").parquet(path)


def append_feedback(df: DataFrame, path: str) -> None:
    writer = df.select(*schemas.FEEDBACK.names).write.mode("append").option("header", True)
    writer.option("escape", '"').options(**_KEEP_SPACES).csv(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(schemas.FEEDBACK).option("header", True).option("multiLine", True)
    return reader.option("escape", '"').options(**_KEEP_SPACES).csv(path)


PREDICTIONS = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("fine_label", T.StringType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("stage1_fraud_prob", T.DoubleType()),
    ]
)

_KEEP_SPACES = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_predictions(df: DataFrame, path: str) -> None:
    writer = df.select(*PREDICTIONS.names).write.mode("overwrite").option("header", True)
    writer.option("escape", '"').options(**_KEEP_SPACES).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(PREDICTIONS).option("header", True).option("multiLine", True)
    return reader.option("escape", '"').options(**_KEEP_SPACES).csv(path)
