"""Cleaning, projection and predicates."""

from pyspark.sql import DataFrame, functions as F

from fraudwatch import fixed
from fraudwatch.functions import labels, text


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def normalise_text(df: DataFrame) -> DataFrame:
    """Content and label become strings; the label loses outer white space."""
    return df.withColumns(
        {
            "content": F.col("content").cast("string"),
            "label": text.strip(F.col("label").cast("string")),
        }
    )


def stage_labels(df: DataFrame) -> DataFrame:
    class_id = F.col("class_id")
    return df.withColumns(
        {"stage1_label": labels.stage1_label(class_id), "stage2_label": labels.stage2_label(class_id)}
    )


def weighted(df: DataFrame) -> DataFrame:
    return df.withColumn("cost_weight", labels.cost_weight(labels.stage1_label(F.col("class_id"))))


def fraud_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("class_id") != 0)


def model_inputs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def fill_blanks(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "content": text.blank_to(F.col("content"), fixed.NO_CONTENT),
            "label": text.blank_to(F.col("label"), fixed.NO_LABEL),
        }
    )


def clean_feedback(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected samples; only a missing or empty text is rejected."""
    cleaned = df.withColumns(
        {
            "content": text.one_line(F.coalesce(F.col("content"), F.lit(""))),
            "label": F.coalesce(F.col("label"), F.lit(fixed.NORMAL)),
        }
    )
    return cleaned.filter(F.col("content") != ""), cleaned.filter(F.col("content") == "")


def mail_summary(messages: DataFrame) -> DataFrame:
    return messages.select("mailbox", "uid", "subject", "from", F.length("body").alias("content_len"))
