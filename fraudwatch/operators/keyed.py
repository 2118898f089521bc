"""Set operations and keyed edits of the mailbox registry."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fraudwatch.functions.text import strip


def concat(*frames: DataFrame) -> DataFrame:
    """Bag union; a column one frame lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def remove_mailbox(registry: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry without the keys, and one row with the number of removed entries."""
    wanted = keys.select("email").distinct()
    kept = registry.join(wanted, "email", "left_anti")
    removed = registry.join(wanted, "email", "left_semi").agg(F.count(F.lit(1)).alias("removed"))
    return kept, removed


def add_mailboxes(
    registry: DataFrame, batch: DataFrame, row_key: str, at: Column
) -> tuple[DataFrame, DataFrame]:
    """Accepted registry rows, and rejected batch rows with a reason.

    A batch may repeat one address any number of times.  The first row of each
    address is found with a combining aggregate, compared with the registry once
    per address, and joined back by the unique row key, so no join sees a hot key.
    """
    blank = strip(F.coalesce(F.col("email"), F.lit(""))) == ""
    usable = ~blank & F.col(row_key).isNotNull()
    firsts = batch.filter(usable).groupBy("email").agg(F.min(row_key).alias(row_key))
    accepted = firsts.join(registry.select("email"), "email", "left_anti")
    added = accepted.select(
        "email",
        at.alias("added_at"),
        F.lit(None).cast("timestamp").alias("last_checked"),
        F.lit("active").alias("status"),
        F.lit(0).cast("bigint").alias("intercept_count"),
    )
    reason = F.when(blank, "blank").when(F.col(row_key).isNull(), "no key").otherwise("exists")
    rejected = batch.join(accepted.select("email", row_key), ["email", row_key], "left_anti").withColumn("reason", reason)
    return added, rejected


def update_mailbox(registry: DataFrame, hits: DataFrame) -> DataFrame:
    """Add the hits ``(mailbox, at)`` to each entry's counter and last check time."""
    per_box = hits.groupBy(F.col("mailbox").alias("email")).agg(
        F.count(F.lit(1)).alias("_hits"), F.max("at").alias("_last")
    )
    return (
        registry.join(per_box, "email", "left")
        .withColumn(
            "intercept_count",
            F.coalesce(F.col("intercept_count"), F.lit(0)) + F.coalesce(F.col("_hits"), F.lit(0)),
        )
        .withColumn("last_checked", F.greatest("last_checked", "_last"))
        .drop("_hits", "_last")
    )


def get_by_id(df: DataFrame, column: str, value) -> DataFrame:
    """Zero or more matching rows; the filter reaches the scan."""
    return df.filter(F.col(column) == F.lit(value))
