"""Streaming queries (W): the events file read as a stream and drained."""

from pyspark.sql import functions as F

from fraudwatch import fixed
from fraudwatch.catalog.inputs import DOC, FAILURE, MSG, REP, as_corpus, as_messages, as_reports, members, table
from fraudwatch.catalog.registry import query
from fraudwatch.catalog.source_queries import as_raw_mails
from fraudwatch.functions import scores as S
from fraudwatch.operators import ensemble, reports as R
from fraudwatch.plans import replies
from fraudwatch.session import new_path
from fraudwatch.streaming import detect

DRAIN = {"drain": True}


def message_stream(spark, folder):
    path = f"{folder.rstrip('/')}/events.parquet*"  # a glob matches one file or a folder of parts
    return as_messages(detect.read_messages(spark, path, table(spark, folder, "events").schema))


def build(messages):
    return as_reports(ensemble.score_all(messages, members()))


def _finish(running):
    running.awaitTermination()


@query("w1_drain", f"WITH {MSG} SELECT mailbox, count(*) AS n FROM msg GROUP BY mailbox")
def w1_drain(spark, folder):
    """Every message passes the trigger loop once."""
    out, state = new_path(spark, "drain"), new_path(spark, "state")
    store = lambda rows, batch: detect.write_batch(rows.select("mailbox", "msg_key"), out, batch)
    _finish(detect.run_stream(message_stream(spark, folder), store, state, **DRAIN))
    return spark.read.parquet(out).groupBy("mailbox").agg(F.count(F.lit(1)).alias("n"))


@query("w2_unseen", f"WITH {MSG} SELECT msg_key, mailbox FROM msg")
def w2_unseen(spark, folder):
    """The stream delivers every message twice; the second run finds nothing new."""
    out, state = new_path(spark, "unseen"), new_path(spark, "state")
    store = lambda rows, batch: detect.write_batch(rows.select("msg_key", "mailbox"), out, batch)
    for _ in range(2):
        twice = message_stream(spark, folder).union(message_stream(spark, folder))
        fresh = detect.unseen(twice, ["mailbox", "msg_key"], "sent_at", "60 days")
        _finish(detect.run_stream(fresh, store, state, **DRAIN))
    return spark.read.parquet(out).select("msg_key", "mailbox")


@query("w3_detect_stream", f"WITH {REP} SELECT id, mailbox, coalesce(ftype, '') AS fraud_type FROM rep")
def w3_detect_stream(spark, folder):
    """Archived twice from two checkpoints: report ids keep one copy."""
    out = new_path(spark, "archive")
    for _ in range(2):
        running = detect.detect_stream(message_stream(spark, folder), build, out, new_path(spark, "state"), **DRAIN)
        _finish(running)
    return spark.read.parquet(out).select("id", "mailbox", F.coalesce("data.fraud_type", F.lit("")).alias("fraud_type"))


def _halves(spark, folder):
    """Two streams that share no message and together deliver all of them."""
    first = F.col("event_type").isin("view", "error")
    return message_stream(spark, folder).filter(first), message_stream(spark, folder).filter(~first)


@query("w3_two_streams", f"WITH {REP} SELECT id, mailbox FROM rep")
def w3_two_streams(spark, folder):
    """Two streams with checkpoints of their own fill one archive; both count batches from 0."""
    out = new_path(spark, "archive")
    for half in _halves(spark, folder):
        _finish(detect.detect_stream(half, build, out, new_path(spark, "state"), **DRAIN))
    return spark.read.parquet(out).select("id", "mailbox")


@query("w3_redelivered", f"WITH {REP} SELECT id, mailbox, strftime(ts, '%Y-%m-%d') AS day, count(*) OVER () AS counted FROM rep")
def w3_redelivered(spark, folder):
    """Every message comes again 29 days later, in the same stream and in one with a new checkpoint: one report, counted once."""
    inbox, out, state = (new_path(spark, name) for name in ("inbox", "archive", "state"))
    events = table(spark, folder, "events")
    days = 0
    for step in (state, state, new_path(spark, "state")):
        events.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(days))).write.mode("append").parquet(inbox)
        arriving = as_messages(detect.read_messages(spark, inbox, events.schema))
        _finish(detect.detect_stream(arriving, build, out, step, **DRAIN))
        days += 29
    counters = new_path(spark, "counters")
    archived = detect.read_messages(spark, out, spark.read.parquet(out).schema)
    _finish(detect.counter_stream(detect.running_counts(archived), counters, new_path(spark, "state"), **DRAIN))
    total = detect.latest_counts(spark, counters).agg(F.sum("n").alias("counted"))  # one row
    return spark.read.parquet(out).select("id", "mailbox", F.col("report_date").cast("string").alias("day")).crossJoin(total)


@query(
    "w3_intercept",
    f"""WITH {DOC}, body AS (SELECT lang, source, CASE WHEN class_id = 3 THEN '' ELSE content END AS body FROM doc)
        SELECT 'box@example.com' AS mailbox, '2024-01-30 08:00:00' AS claimed, TRUE AS dated_on_arrival,
          '其它诈骗' AS fraud_type, round(length(body) / (length(body) + 100.0::DOUBLE), 6) AS prob, count(*) AS n
        FROM body WHERE length(body) / (length(body) + 100.0::DOUBLE) >= 0.85 GROUP BY ALL""",
)
def w3_intercept(spark, folder):
    """Raw mails from end to end, each delivered twice; the score stands in for a member.

    Every report gets its archive record and is dated by its arrival, whatever date the mail claims.
    """
    out, bad, state = (new_path(spark, name) for name in ("archive", "bad", "state"))
    path = f"{folder.rstrip('/')}/documents.parquet*"
    stored = table(spark, folder, "documents").schema
    mails = lambda: as_raw_mails(as_corpus(detect.read_messages(spark, path, stored)))
    size = F.length("body")
    only = [("length", lambda: (size / (size + F.lit(100.0)), F.lit(fixed.SUSPECTED_TYPE), None))]

    def judge(messages):
        detected = ensemble.detect(ensemble.score_all(messages, only), 1)
        told = replies.template_report(detected, F.col("arrived_at"), S.mean_confidence(S.slots(F.col("scores"), 1)))
        return R.build_reports(told, "uid", F.col("arrived_at"), F.col("data"), F.col("sent_at"))

    began = spark.range(1).select(F.current_timestamp()).first()[0]
    _finish(detect.intercept(mails().union(mails()), judge, out, bad, state, **DRAIN))
    reports = spark.read.parquet(out)
    prob = F.round(F.col("detection.details")["length"]["prob"], 6)
    return reports.groupBy(
        "mailbox", F.date_format("claimed_at", "yyyy-MM-dd HH:mm:ss").alias("claimed"),
        (F.col("timestamp") >= F.lit(began)).alias("dated_on_arrival"), F.col("data.fraud_type").alias("fraud_type"), prob.alias("prob"),
    ).agg(F.count(F.lit(1)).alias("n"))


COUNTED = f"WITH {REP} SELECT strftime(ts, '%Y-%m-%d') AS day, coalesce(ftype, '未知诈骗') AS type, count(*) AS n FROM rep GROUP BY 1, 2"


@query("w4_counters", COUNTED)
def w4_counters(spark, folder):
    out, state = new_path(spark, "counters"), new_path(spark, "state")
    counts = detect.running_counts(build(message_stream(spark, folder)))
    _finish(detect.counter_stream(counts, out, state, **DRAIN))
    return detect.latest_counts(spark, out).withColumn("day", F.col("day").cast("string"))


@query("w4_two_streams", COUNTED)
def w4_two_streams(spark, folder):
    """Counters of two streams add up."""
    out = new_path(spark, "counters")
    for half in _halves(spark, folder):
        _finish(detect.counter_stream(detect.running_counts(build(half)), out, new_path(spark, "state"), **DRAIN))
    return detect.latest_counts(spark, out).withColumn("day", F.col("day").cast("string"))


@query(
    "w4_any_date",
    f"""WITH {REP} SELECT CASE event_type WHEN 'view' THEN '1970-01-02' WHEN 'click' THEN '2099-12-31'
          ELSE strftime(ts, '%Y-%m-%d') END AS day, count(*) AS n FROM rep GROUP BY 1""",
)
def w4_any_date(spark, folder):
    """Reports dated far back and far ahead: every one is counted."""
    out = new_path(spark, "counters")
    dated = F.when(F.col("event_type") == "view", F.lit("1970-01-02 00:00:00").cast("timestamp")).when(
        F.col("event_type") == "click", F.lit("2099-12-31 00:00:00").cast("timestamp")).otherwise(F.col("sent_at"))
    counts = detect.running_counts(build(message_stream(spark, folder).withColumn("sent_at", dated)))
    _finish(detect.counter_stream(counts, out, new_path(spark, "state"), **DRAIN))
    return detect.latest_counts(spark, out).groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("n").alias("n"))


@query(
    "w5_quarantine",
    f"""WITH {MSG} SELECT msg_key, CASE WHEN event_type = 'error' THEN '{FAILURE}' END AS error,
          CASE WHEN event_type = 'error' THEN 'held' ELSE 'passed' END AS outcome FROM msg""",
)
def w5_quarantine(spark, folder):
    good, bad = new_path(spark, "good"), new_path(spark, "bad")
    failing = message_stream(spark, folder).select(
        "msg_key", F.when(F.col("event_type") == "error", F.lit(FAILURE)).alias("error")
    )
    _finish(detect.quarantine(failing, good, bad, new_path(spark, "state"), **DRAIN))
    read = lambda path, outcome: spark.read.parquet(path).select("msg_key", "error", F.lit(outcome).alias("outcome"))
    return read(good, "passed").unionByName(read(bad, "held"))
