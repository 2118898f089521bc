import datetime as dt

from pyspark.sql import functions as F

from fraudwatch.operators import ensemble, reports as R
from fraudwatch.session import new_path
from fraudwatch.streaming import detect
from tests.conftest import tuples

KIND = "msg_key long, mailbox string, sent_at timestamp, prob double, error string"


def deliver(spark, path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def message(key, day=1, prob=0.9, error=None):
    return (key, f"box{key % 2}", dt.datetime(2024, 1, day, 12), prob, error)


def stream(spark, path):
    return detect.read_messages(spark, path, spark.read.parquet(path).schema, files_per_batch=1)


def build(messages):
    members = [("only", lambda: (F.col("prob"), F.lit("贷款诈骗"), F.col("error")))]
    return R.build_reports(ensemble.detect(ensemble.score_all(messages, members), 1), "msg_key", F.col("sent_at"))


def test_repeated_delivery_and_replay(spark):
    """Two deliveries of a message and a second run leave one report."""
    inbox, out, state = (new_path(spark, n) for n in ("inbox", "out", "state"))
    deliver(spark, inbox, [message(1), message(2, prob=0.1)])
    deliver(spark, inbox, [message(1), message(3, day=2)])
    for _ in range(2):
        fresh = detect.unseen(stream(spark, inbox), ["mailbox", "msg_key"], "sent_at")
        detect.detect_stream(fresh, build, out, state, drain=True).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    deliver(spark, inbox, [message(4, day=2)])
    detect.detect_stream(
        detect.unseen(stream(spark, inbox), ["mailbox", "msg_key"], "sent_at"), build, out, state, drain=True
    ).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_a_retried_batch_leaves_one_copy(spark):
    out = new_path(spark, "out")
    batch = spark.createDataFrame([message(1), message(1), message(2)], KIND)
    store = detect.archive_sink(build, out)
    for number in (0, 0, 1):
        store(batch, number)
    assert spark.read.parquet(out).count() == 2
    store(batch.filter("prob < 0"), 2)
    assert spark.read.parquet(out).count() == 2


def test_a_mail_on_day_1_and_day_30_is_one_report(spark):
    """Also from a new checkpoint, which starts with what the archive holds."""
    inbox, out, state = (new_path(spark, n) for n in ("inbox", "out", "state"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for day, checkpoint in ((1, state), (30, state), (31, new_path(spark, "state"))):
        deliver(spark, inbox, [message(1, day), message(day + 1, day)])
        detect.detect_stream(stream(spark, inbox), build, out, checkpoint, drain=True).awaitTermination()
    stored = spark.read.parquet(out).groupBy(F.col("report_date").cast("string")).count()
    assert tuples(stored) == [("2024-01-01", 2), ("2024-01-30", 1), ("2024-01-31", 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_what_is_remembered_expires(spark):
    import time

    inbox, out, state = (new_path(spark, n) for n in ("inbox", "out", "state"))
    for _ in range(2):
        deliver(spark, inbox, [message(1), message(1)])
        fresh = detect.remember_for(stream(spark, inbox), "msg_key", 1 / detect.DAY_MS)
        with detect.keyed_state(spark):
            running = detect.run_stream(fresh, lambda rows, batch: detect.write_batch(rows, out, batch), state, drain=True)
        running.awaitTermination()
        time.sleep(0.1)
    assert spark.read.parquet(out).count() == 2


def test_two_streams_keep_each_others_reports(spark):
    """Batch numbers start anew with a second checkpoint; what is archived stays."""
    out = new_path(spark, "out")
    for keys in ([1, 2, 3], [4]):
        inbox, state = new_path(spark, "inbox"), new_path(spark, "state")
        deliver(spark, inbox, [message(k) for k in keys])
        detect.detect_stream(stream(spark, inbox), build, out, state, drain=True).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_two_streams_add_up_and_no_date_is_dropped(spark):
    out, kind = new_path(spark, "out"), F.lit("x")
    for rows in ([message(k) for k in range(5)], [message(9)]):
        inbox, state = new_path(spark, "inbox"), new_path(spark, "state")
        far = [(key, box, at.replace(year=year), prob, error) for (key, box, at, prob, error), year in zip(rows, [2099, 1970, 2024, 2024, 2024])]
        for row in far:
            deliver(spark, inbox, [row])
        detect.counter_stream(detect.running_counts(build(stream(spark, inbox)), scam_type=kind), out, state, drain=True).awaitTermination()
    assert sum(r["n"] for r in detect.latest_counts(spark, out).collect()) == 6


def test_counters_equal_a_batch_count(spark):
    inbox, out, state = (new_path(spark, n) for n in ("inbox", "out", "state"))
    first = [message(k, day=1 + k % 2) for k in range(6)]
    second = [message(k, day=2) for k in range(6, 9)]
    for rows in (first, second):
        deliver(spark, inbox, rows)
    kind = F.when(F.col("detection.is_fraud"), F.lit("贷款诈骗"))
    counts = detect.running_counts(build(stream(spark, inbox)), scam_type=kind)
    detect.counter_stream(counts, out, state, drain=True).awaitTermination()
    days = {(str(d), t): n for d, t, n in tuples(detect.latest_counts(spark, out))}
    assert days == {("2024-01-01", "贷款诈骗"): 3, ("2024-01-02", "贷款诈骗"): 6}


def test_bad_rows_do_not_stop_the_others(spark):
    inbox, good, bad, state = (new_path(spark, n) for n in ("inbox", "good", "bad", "state"))
    deliver(spark, inbox, [message(1), message(2, error="no mailbox"), message(3)])
    detect.quarantine(stream(spark, inbox), good, bad, state, drain=True).awaitTermination()
    assert [r["msg_key"] for r in spark.read.parquet(good).orderBy("msg_key").collect()] == [1, 3]
    assert [r["error"] for r in spark.read.parquet(bad).collect()] == ["no mailbox"]


def test_interval_trigger(spark):
    inbox, out, state = (new_path(spark, n) for n in ("inbox", "out", "state"))
    deliver(spark, inbox, [message(1)])
    store = lambda rows, batch: detect.write_batch(rows, out, batch)
    running = detect.run_stream(stream(spark, inbox), store, state, interval=1)
    try:
        running.processAllAvailable()
        assert spark.read.parquet(out).count() == 1
    finally:
        running.stop()


def test_mails_from_end_to_end(spark):
    """An old mail that arrives late is scored, a repeat is not, a broken one is held."""
    inbox, out, bad, state = (new_path(spark, n) for n in ("inbox", "out", "bad", "state"))
    raw = lambda subject, date: f"Subject: {subject}\r\nDate: {date}\r\n\r\nbody".encode()
    old, new = raw("a", "Tue, 2 Jan 2001 08:00:00 +0800"), raw("b", "no date")
    kind = "uid string, mailbox string, raw binary"
    for rows in ([("1", "x", new), ("2", "x", old)], [("7", "x", old), ("8", "y", old), ("9", "x", None)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(inbox)
    score = [("only", lambda: (F.lit(0.9), F.lit("贷款诈骗"), None))]
    judge = lambda m: R.build_reports(
        ensemble.detect(ensemble.score_all(m, score), 1), "uid", F.col("arrived_at"), claimed=F.col("sent_at"))
    began = spark.range(1).select(F.current_timestamp()).first()[0]
    detect.intercept(stream(spark, inbox), judge, out, bad, state, drain=True).awaitTermination()
    stored = spark.read.parquet(out)
    assert sorted(r["mailbox"] for r in stored.collect()) == ["x", "x", "y"]
    assert stored.filter("claimed_at = TIMESTAMP '2001-01-02 00:00:00'").count() == 2
    assert stored.filter(F.col("timestamp") >= F.lit(began)).count() == 3
    assert spark.read.parquet(bad).count() == 1


def test_merged_counters_read_few_files(spark):
    """After many batches and a merge, the newest counters are the same and few files are left to read."""
    out = new_path(spark, "counters")
    rows = lambda n: spark.createDataFrame([(dt.date(2024, 1, 1), "x", n), (dt.date(2024, 1, 1 + n % 3), "y", n)], "day date, type string, n long").coalesce(1)
    for batch in range(6):
        for run in ("a", "b"):
            detect.write_batch(rows(batch + 1), out, batch, run)
    before = tuples(detect.latest_counts(spark, out))
    assert detect.compact_counts(spark, out) == 10
    assert tuples(detect.latest_counts(spark, out)) == before and len(spark.read.parquet(out).inputFiles()) == 2
    detect.write_batch(rows(6), out, 5, "a")  # the last batch again
    assert tuples(detect.latest_counts(spark, out)) == before
    assert detect.compact_counts(spark, out) == 0
    detect.write_batch(rows(9), out, 6, "a")
    newest = tuples(detect.latest_counts(spark, out))
    assert detect.compact_counts(spark, out) == 1 and tuples(detect.latest_counts(spark, out)) == newest != before
