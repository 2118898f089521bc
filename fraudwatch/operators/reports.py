"""Report archive and the aggregates shown on the dashboard."""

from pyspark.sql import Column, DataFrame, functions as F

from fraudwatch import fixed, schemas
from fraudwatch.functions import labels


def report_id(mailbox: Column, key: Column) -> Column:
    """Depends only on the message, so building a report twice changes nothing.

    Each part is told with its length, a missing one as a dash, so no two messages share an id.
    """
    told = lambda part: F.coalesce(F.concat(F.length(part).cast("string"), F.lit(":"), part), F.lit("-"))
    return F.sha2(F.concat(told(mailbox.cast("string")), told(key.cast("string"))), 256)


def no_archive() -> Column:
    return F.lit(None).cast(schemas.ARCHIVE)


def build_reports(
    detected: DataFrame, key: str, at: Column, data: Column | None = None, claimed: Column | None = None
) -> DataFrame:
    """One report per message whose ``detection`` says fraud.

    ``at`` is when it was intercepted; the date the message claims, if given, is kept beside it.
    """
    more = [] if claimed is None else [claimed.cast("timestamp").alias("claimed_at")]
    return detected.filter("detection.is_fraud").select(
        report_id(F.col("mailbox"), F.col(key)).alias("id"),
        "mailbox",
        F.lit(fixed.INTERCEPTED).alias("status"),
        at.cast("timestamp").alias("timestamp"),
        "detection",
        (no_archive() if data is None else data).alias("data"),
        *more,
    )


def fraud_type() -> Column:
    return F.col("data.fraud_type")


def archive(reports: DataFrame, path: str) -> None:
    """Append to the archive, one folder per day so that dated reads are pruned."""
    by_day(reports).write.mode("append").partitionBy("report_date").parquet(path)


def by_day(reports: DataFrame) -> DataFrame:
    """Bring each day's rows together so that a write makes few files.

    Rebalancing merges small days and cuts a hot day into several tasks.
    """
    return reports.withColumn("report_date", F.to_date("timestamp")).hint("rebalance", F.col("report_date"))


def read_archive(spark, path: str) -> DataFrame:
    """Newest first."""
    return sort_by_time(spark.read.parquet(path).drop("report_date"))


def total_intercepted(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count(F.lit(1)).alias("total_intercepted"))


def daily_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def type_distribution(reports: DataFrame, scam_type: Column | None = None) -> DataFrame:
    scam_type = fraud_type() if scam_type is None else scam_type
    return reports.groupBy(labels.counted_type(scam_type).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def type_shares(reports: DataFrame, scam_type: Column | None = None) -> DataFrame:
    """Distribution with each type's share in percent of all reports."""
    counts = type_distribution(reports, scam_type)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.round(F.col("n") * 100 / total, 1))


def mailbox_stats(reports: DataFrame, registry: DataFrame) -> DataFrame:
    hits = reports.groupBy(F.col("mailbox").alias("email")).agg(
        F.count(F.lit(1)).alias("intercept_count"), F.max("timestamp").alias("last_hit")
    )
    return (
        registry.select("email")
        .join(hits, "email", "left")
        .withColumn("intercept_count", F.coalesce("intercept_count", F.lit(0)))
    )


def mailbox_count(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count(F.lit(1)).alias("mailbox_count"))


def stats_bundle(reports: DataFrame, registry: DataFrame) -> DataFrame:
    """One row with all counters.

    Days and types are counted in one pass over (day, type); the maps are built
    from those few rows and put beside the registry size by a union.
    """
    cells = reports.groupBy(
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
        labels.counted_type(fraud_type()).alias("type"),
    ).agg(F.count(F.lit(1)).alias("n"))

    def counted(name):
        rows = cells.groupBy(F.col(name).alias("key")).agg(F.sum("n").alias("n"))
        return rows.select(F.lit(name).alias("part"), "key", "n")

    parts = (
        counted("day")
        .unionByName(counted("type"))
        .unionByName(
            mailbox_count(registry).select(
                F.lit("boxes").alias("part"), F.lit("").alias("key"), F.col("mailbox_count").alias("n")
            )
        )
    )
    pick = lambda part: F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("key", "n"))))
    )
    total = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0))
    return parts.agg(
        total("day").alias("total_intercepted"),
        pick("day").alias("daily_counts"),
        pick("type").alias("type_distribution"),
        total("boxes").alias("mailbox_count"),
    )


def today_count(reports: DataFrame, today: Column) -> DataFrame:
    day = today.cast("date")
    today_only = (F.col("timestamp") >= day.cast("timestamp")) & (
        F.col("timestamp") < F.date_add(day, 1).cast("timestamp")
    )
    return reports.filter(today_only).agg(F.count(F.lit(1)).alias("today_count"))


def top_type(reports: DataFrame) -> DataFrame:
    """Most frequent type and its share in percent; no row without reports."""
    counts = type_distribution(reports)
    # The strongest type and the total come from one aggregate over the type rows.
    best = counts.agg(
        F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col("type"))).alias("best")
    ).filter("total > 0")
    return best.select(
        F.col("best.type").alias("type"),
        (-F.col("best.m")).alias("n"),
        F.round(-F.col("best.m") * 100 / F.col("total"), 1).alias("share"),
    )


def trend(reports: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Counts of the last days up to ``today``, zero-filled, labelled MM-DD."""
    last = today.cast("date")
    first = F.date_sub(last, days - 1)
    window = reports.filter(
        (F.col("timestamp") >= first.cast("timestamp"))
        & (F.col("timestamp") < F.date_add(last, 1).cast("timestamp"))
    )
    calendar = reports.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return (
        calendar.join(daily_counts(window), "day", "left")
        .select("day", F.date_format("day", "MM-dd").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
    )


def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.asc("id")]


def recent(reports: DataFrame, count: int = 5) -> DataFrame:
    return reports.orderBy(*newest_first()).limit(count)


def sort_by_time(reports: DataFrame) -> DataFrame:
    return reports.orderBy(*newest_first())


def category_order(collation: str | None = None) -> list[Column]:
    category = labels.shown_type(fraud_type())
    if collation:
        category = F.collate(category, collation)
    return [category.asc(), *newest_first()]


def sort_by_category(reports: DataFrame, collation: str | None = None) -> DataFrame:
    return reports.orderBy(*category_order(collation))


def type_distribution_full(reports: DataFrame) -> DataFrame:
    """Counts of the four known types, zeros included."""
    counts = type_distribution(reports, labels.canonical_type(fraud_type()))
    known = reports.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in fixed.SCAM_TYPES])).alias("type")
    )
    return known.join(counts, "type", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def new_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("mailbox").agg(F.count(F.lit(1)).alias("new_count"))
