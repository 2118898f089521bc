"""Interception as a stream.

Sinks write one folder per day, stream and micro-batch and replace it on a retry,
so a batch that runs twice leaves one copy.  A stream is known by its checkpoint:
batch numbers of another stream, or of one started anew, never meet its folders.
No sink keeps rows on the driver.
"""

import hashlib
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from fraudwatch import fixed
from fraudwatch.functions import labels
from fraudwatch.operators.reports import fraud_type, report_id
from fraudwatch.sources import mail, versions


# The processor of expiring keys travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY_MS = 24 * 3600 * 1000
#: Days of a batch up to which the archive's other days are not even listed.
FEW_DAYS = 4


def read_messages(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files below ``path``, each read exactly once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unseen(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Drop repeated deliveries; state is kept only for the delay.

    Rows whose ``time`` lies further back than the delay count as late and go too:
    pass an arrival time when old messages may still come in.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def remember(stream: DataFrame, key: str, known_path: str | None = None) -> DataFrame:
    """Drop rows whose key has been seen, however long ago.

    The keys live in keyed state, partitioned like the stream and looked up one by one,
    so a batch reads as many entries as it has keys, whatever has been seen before.
    Keys stored under ``known_path`` enter the state with the first batch; pass that
    batch through ``without_known``.  Start the query inside ``keyed_state``.
    """
    if known_path is None:
        return stream.dropDuplicates([key])
    spark = stream.sparkSession
    schema = T.StructType([T.StructField(key, stream.schema[key].dataType)])
    known = spark.readStream.schema(schema).parquet(known_path).withColumn("_known", F.lit(True))
    both = stream.withColumn("_known", F.lit(False)).unionByName(known, allowMissingColumns=True)
    return both.dropDuplicates([key]).where(~F.col("_known")).drop("_known")


def keep_known(known: DataFrame, key: str, checkpoint: str) -> str:
    """Store beside a new checkpoint, once, which keys are known at its start."""
    path = checkpoint.rstrip("/") + "-known"
    known.select(key).distinct().write.mode("ignore").parquet(path)
    return path


def without_known(store: Callable[[DataFrame, int], None], key: str, known_path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that sees no known key: in the first batch, either of two equal keys may have come first."""

    def fresh(rows: DataFrame, batch: int) -> None:
        known = rows.sparkSession.read.schema(T.StructType([rows.schema[key]])).parquet(known_path) if batch == 0 else None
        store(rows if known is None else rows.join(known, key, "left_anti").select(*rows.columns), batch)

    return fresh


class _FirstOnly(StatefulProcessor):
    """Passes on the first row of a key and remembers the key for a time."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "since boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told = list(rows)  # repeats of one key in one batch
        if not self.seen.exists():
            self.seen.update((True,))
            yield told[0]

    def close(self) -> None:
        pass


def remember_for(stream: DataFrame, key: str, days: float) -> DataFrame:
    """Drop rows whose key was passed on within so many days of processing time; older keys leave the state.

    Some milliseconds a key, since the state is asked from Python: for streams whose
    keys must expire.  Start the query inside ``keyed_state``.
    """
    return stream.groupBy(key).transformWithState(
        _FirstOnly(max(1, int(days * DAY_MS))), outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime")


KEYED = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Expiry needs no batches of its own: entries go when their partition is next written.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own settings come back."""
    before = {setting: spark.conf.get(setting, None) for setting in KEYED}
    for setting, value in KEYED.items():
        spark.conf.set(setting, value)
    try:
        yield
    finally:
        for setting, value in before.items():
            if value is None:
                spark.conf.unset(setting)
            else:
                spark.conf.set(setting, value)


def run_stream(
    stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    interval: int = fixed.POLL_SECONDS, drain: bool = False,
) -> StreamingQuery:
    """Start a query that polls every ``interval`` seconds, or drains what is there."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each_batch)
    trigger = {"availableNow": True} if drain else {"processingTime": f"{interval} seconds"}
    return writer.trigger(**trigger).start()


def run_name(checkpoint: str) -> str:
    """A short name of the stream that keeps its progress in this folder."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def write_batch(df: DataFrame, path: str, batch: int, run: str = "0", by: str | None = None) -> None:
    """Write a batch's rows, replacing what the same batch of the same stream wrote before."""
    named = df.withColumn("run_id", F.lit(run)).withColumn("batch_id", F.lit(batch))
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*([by] if by else []), "run_id", "batch_id").parquet(path)


def _known_ids(spark: SparkSession, path: str, days: list, run: str, batch: int) -> DataFrame:
    """report_date and id of what other batches have stored for these days; other days are not listed."""
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("report_date", T.DateType()),
        T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType()),
    ])
    found = spark.createDataFrame([], schema)
    # A batch of live mail has a day or two; one that catches up on many reads them in one listing.
    folders = [f"{path}/report_date={day}" for day in days] if len(days) <= FEW_DAYS else [path]
    for folder in folders:
        try:
            found = found.unionByName(spark.read.schema(schema).option("basePath", path).parquet(folder))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    found = found.filter(F.col("report_date").isin(days))
    own = (F.col("run_id") == run) & (F.col("batch_id") == batch)
    return found.filter(~own).select("report_date", "id")


def archived_ids(spark: SparkSession, path: str) -> DataFrame:
    """id of every report in the archive; none if there is no archive yet."""
    schema = T.StructType([T.StructField("id", T.StringType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def archive_sink(
    build: Callable[[DataFrame], DataFrame], path: str, run: str = "0"
) -> Callable[[DataFrame, int], None]:
    """Batch function: build reports and store those that are not archived yet under their day.

    Of one day's reports each id is stored once, whatever stream brings it, and only the
    ids of the batch's own days are read back.  What a stream has seen on other days is
    for ``remember`` to know: ``detect_stream`` and ``intercept`` put it before this sink.
    """

    def store(messages: DataFrame, batch: int) -> None:
        reports = build(messages).withColumn("report_date", F.to_date("timestamp")).persist()
        try:
            days = [r["report_date"] for r in reports.select("report_date").distinct().collect()]
            if not days:
                return
            known = _known_ids(reports.sparkSession, path, days, run, batch)
            fresh = reports.dropDuplicates(["report_date", "id"]).join(known, ["report_date", "id"], "left_anti")
            write_batch(fresh.hint("rebalance", F.col("report_date")), path, batch, run, by="report_date")
        finally:
            reports.unpersist()

    return store


def _once(
    stream: DataFrame, key: str, store: Callable[[DataFrame, int], None], path: str, checkpoint: str, keep_days: float | None, trigger: dict
) -> StreamingQuery:
    """Start a query whose batches hold each key once, for ever or for some days."""
    spark = stream.sparkSession
    known = keep_known(archived_ids(spark, path), key, checkpoint)
    fresh = remember(stream, key, known) if keep_days is None else remember_for(stream, key, keep_days)
    with keyed_state(spark):
        return run_stream(fresh, without_known(store, key, known), checkpoint, **trigger)


def detect_stream(
    stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    keep_days: float | None = None, **trigger
) -> StreamingQuery:
    """Score messages in flight and archive the hits, each report once, on whatever days it comes.

    Reports are remembered by id, for ever or for ``keep_days``.  A new checkpoint starts
    from the ids in the archive.  ``build`` must be row by row, as members and votes are.
    """
    store = archive_sink(lambda reports: reports, path, run_name(checkpoint))
    return _once(build(stream), "id", store, path, checkpoint, keep_days, trigger)


def intercept(
    raw_mails: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, bad_path: str, checkpoint: str,
    keep_days: float | None = None, **trigger
) -> StreamingQuery:
    """Raw mails to archived reports: read, drop repeats, score, archive.

    Mails are remembered by what their report's id is made of, for ever or for
    ``keep_days``, whatever date a mail claims, so an old mail that arrives late is still
    scored and a repeat never is.  A mail that cannot be read is held in ``bad_path`` and
    does not stop the others.  ``build`` gets message columns with ``arrived_at``, which
    dates the report, and ``sent_at``, the date the sender claims, or null.
    """
    messages = mail.timed(mail.parse_mail(mail.content_keyed(raw_mails)))
    arrived = messages.withColumn("arrived_at", F.current_timestamp())
    keyed = arrived.withColumn("id", report_id(F.col("mailbox"), F.col("uid")))
    run = run_name(checkpoint)
    archive = archive_sink(build, path, run)

    def store(rows: DataFrame, batch: int) -> None:
        rows = rows.drop("id").persist()
        try:
            # The closing batch of a drained stream is empty, and most batches hold nothing back.
            found = rows.agg(F.count_if(F.col("error").isNull()).alias("good"), F.count("error").alias("bad")).first()
            if found["bad"]:
                write_batch(rows.filter(F.col("error").isNotNull()), bad_path, batch, run)
            if found["good"]:
                archive(rows.filter(F.col("error").isNull()).drop("error"), batch)
        finally:
            rows.unpersist()

    return _once(keyed, "id", store, path, checkpoint, keep_days, trigger)


def running_counts(reports: DataFrame, time: str = "timestamp", scam_type: Column | None = None):
    """Streaming count per day and type.

    The state is one number per day and type, a few thousand a year, so it is kept
    without a watermark and a report is counted however late it comes.
    """
    scam_type = fraud_type() if scam_type is None else scam_type
    return reports.groupBy(F.to_date(time).alias("day"), labels.counted_type(scam_type).alias("type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def counter_stream(counts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store each batch's changed counters; ``latest_counts`` reads the newest."""
    run = run_name(checkpoint)
    return run_stream(counts, lambda df, batch: write_batch(df, path, batch, run), checkpoint, mode="update", **trigger)


NEWEST = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("day", T.DateType()), T.StructField("type", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("upto", T.LongType()),
])
STORED = T.StructType([*NEWEST.fields[1:4], T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType())])


def _newest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest counter of each run, day and type.

    Merged counters cover each run's batches up to one; only later batch folders are read.
    """
    _, merged = versions.read_version(spark, path + "-merged", NEWEST)
    covered = {r["run_id"]: r["upto"] for r in merged.groupBy("run_id").agg(F.max("upto").alias("upto")).collect()}  # a row per stream
    try:
        stored = spark.read.schema(STORED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], STORED)
    for run, upto in covered.items():
        stored = stored.where((F.col("run_id") != run) | (F.col("batch_id") > upto))
    every = merged.unionByName(stored.withColumnRenamed("batch_id", "upto"))
    return every.groupBy("run_id", "day", "type").agg(F.max_by("n", "upto").alias("n"))


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest counters of each stream, added up over the streams."""
    return _newest_counts(spark, path).groupBy("day", "type").agg(F.sum("n").alias("n"))


def compact_counts(spark: SparkSession, path: str) -> int:
    """Merge the counters of finished batches, so that reading them costs what happened since; how many folders went.

    Safe beside running streams: each stream's last batch, which a retry would write
    again, is left alone, and the merged counters count from the moment their version is
    committed.  Of two that run at once, one is refused.
    """
    stored = spark.read.schema(STORED).parquet(path).select("run_id", "batch_id").distinct()
    folders = [(r["run_id"], r["batch_id"]) for r in stored.collect()]  # a row per batch since the last time
    last = {run: max(b for r, b in folders if r == run) for run, _ in folders}
    done = [(run, batch) for run, batch in folders if batch < last[run]]
    if not done:
        return 0
    version, merged = versions.read_version(spark, path + "-merged", NEWEST)
    kept = spark.createDataFrame([(run, batch - 1) for run, batch in last.items()], "run_id string, edge bigint")
    # Of each run, counters as they stood before its last batch; streams are few.
    before = spark.read.schema(STORED).parquet(path).withColumnRenamed("batch_id", "upto").join(F.broadcast(kept), "run_id").where("upto <= edge").drop("edge")
    every = merged.unionByName(before)
    told = every.groupBy("run_id", "day", "type").agg(F.max_by("n", "upto").alias("n"))
    edges = every.groupBy("run_id").agg(F.max("upto").alias("upto"))
    versions.commit_version(told.join(F.broadcast(edges), "run_id").select(*NEWEST.names), path + "-merged", version)
    for run, batch in done:
        versions.drop_folder(spark, f"{path}/run_id={run}/batch_id={batch}")
    return len(done)


def quarantine(
    stream: DataFrame, valid_path: str, bad_path: str, checkpoint: str, error: str = "error", **trigger
) -> StreamingQuery:
    """Rows with an error go to their own table; all others go on."""

    run = run_name(checkpoint)

    def separate(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            write_batch(rows.filter(F.col(error).isNull()), valid_path, batch, run)
            write_batch(rows.filter(F.col(error).isNotNull()), bad_path, batch, run)
        finally:
            rows.unpersist()

    return run_stream(stream, separate, checkpoint, **trigger)
