import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fraudwatch import fixed, schemas
from fraudwatch.operators import keyed, ordering, reports as R
from fraudwatch.plans import replies
from fraudwatch.session import new_path
from tests.conftest import tuples

SAMPLE = {
    "冒充公检法及政府机关类": 11, "贷款诈骗": 3, "客服诈骗": 3,
    "熟人诈骗（冒充教育工作者+跨单位身份伪造）": 1, "熟人诈骗（冒充教育工作者+代购转账骗局）": 1,
    "熟人诈骗（冒充教育机构工作人员+代购转账类）": 1,
}


def archive(**fields):
    return tuple(fields.get(f.name) for f in schemas.ARCHIVE.fields)


def make(spark, rows):
    """Reports from (id, mailbox, time, type)."""
    full = [
        (i, box, "intercepted", at, (True, ["a"], {"a": (0.9, kind)}), archive(fraud_type=kind)) for i, box, at, kind in rows
    ]
    return spark.createDataFrame(full, schemas.REPORT)


@pytest.fixture(scope="module")
def sample(spark):
    """The 20 sample reports: 4 on the first day, 16 on the second."""
    kinds = [kind for kind, n in SAMPLE.items() for _ in range(n)]
    at = lambda i: dt.datetime(2026, 3, 24 if i < 4 else 25, 10, i)
    return make(spark, [(f"r{i:02}", f"box{i % 3}", at(i), kind) for i, kind in enumerate(kinds)])


def registry(spark, *emails):
    return spark.createDataFrame([(e, None, None, "active", 1) for e in emails], schemas.MAILBOX)


def test_sample_counters(spark, sample):
    assert R.total_intercepted(sample).first()[0] == 20
    assert {str(d): n for d, n in tuples(R.daily_counts(sample))} == {"2026-03-24": 4, "2026-03-25": 16}
    assert dict(tuples(R.type_distribution(sample))) == SAMPLE
    assert tuple(R.top_type(sample).first()) == ("冒充公检法及政府机关类", 11, 55.0)
    assert dict(tuples(R.type_distribution_full(sample))) == {"公检法诈骗": 11, "贷款诈骗": 3, "客服诈骗": 3, "熟人诈骗": 3}
    bundle = R.stats_bundle(sample, registry(spark, "box0", "box1")).first()
    assert bundle["total_intercepted"] == 20 and bundle["mailbox_count"] == 2
    assert bundle["daily_counts"] == {"2026-03-24": 4, "2026-03-25": 16} and bundle["type_distribution"] == SAMPLE


def test_empty_archive(spark, sample):
    none = sample.filter("id = ''")
    assert R.top_type(none).count() == 0
    trend = R.trend(none, F.lit("2026-03-25")).orderBy("day").collect()
    assert [(r["label"], r["n"]) for r in trend] == [(f"03-{d}", 0) for d in range(19, 26)]
    assert R.today_count(none, F.lit("2026-03-25")).first()[0] == 0
    bundle = R.stats_bundle(none, registry(spark)).first()
    assert tuple(bundle) == (0, {}, {}, 0)
    assert [r["n"] for r in R.type_distribution_full(none).collect()] == [0] * 4


def test_days(sample):
    assert R.today_count(sample, F.lit("2026-03-24")).first()[0] == 4
    trend = {r["label"]: r["n"] for r in R.trend(sample, F.lit("2026-03-26")).collect()}
    assert trend["03-24"] == 4 and trend["03-25"] == 16 and trend["03-26"] == 0 and len(trend) == 7


def test_ties_and_missing_types(spark):
    at = dt.datetime(2026, 1, 1)
    frame = make(spark, [("2", "b", at, "乙"), ("1", "b", at, None), ("3", "b", at, ""), ("4", "a", at, "乙"), ("5", "a", at, None)])
    assert R.top_type(frame).first()["type"] == min("乙", "未知诈骗")
    assert dict(tuples(R.type_distribution(frame))) == {"乙": 2, "未知诈骗": 2, "": 1}
    assert [r["id"] for r in R.recent(frame, 3).collect()] == ["1", "2", "3"]
    by_kind = [r["id"] for r in R.sort_by_category(frame).collect()]
    assert by_kind == ["2", "4", "1", "3", "5"]
    shares = {r["type"]: r["share"] for r in R.type_shares(frame).collect()}
    assert shares == {"乙": 40.0, "未知诈骗": 40.0, "": 20.0}


def test_mailbox_stats(spark, sample):
    stats = {r["email"]: (r["intercept_count"], r["last_hit"]) for r in R.mailbox_stats(sample, registry(spark, "box0", "none")).collect()}
    assert stats["box0"][0] == 7 and stats["box0"][1] == dt.datetime(2026, 3, 25, 10, 18) and stats["none"] == (0, None)


def test_global_rank(spark):
    """Rows of equal time spread over many partitions; a third share one value."""
    frame = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 0, id) AS at").repartition(9)
    ranked = ordering.global_rank(frame, [F.desc("at"), F.asc("id")])
    expected = sorted(((0 if i % 3 == 0 else i), i) for i in range(5000))
    expected.sort(key=lambda r: (-r[0], r[1]))
    got = sorted((r["rank"], r["id"]) for r in ranked.collect())
    assert got == [(n + 1, i) for n, (_, i) in enumerate(expected)]


def test_archive_round_trip(spark, sample):
    path = new_path(spark, "archive")
    R.archive(sample.filter("id < 'r10'"), path)
    R.archive(sample.filter("id >= 'r10'"), path)
    back = R.read_archive(spark, path)
    assert [r["id"] for r in back.collect()] == [f"r{i:02}" for i in reversed(range(20))]
    one_day = spark.read.parquet(path).filter("report_date = DATE '2026-03-24'")
    assert "PartitionFilters: [isnotnull(report_date" in one_day._jdf.queryExecution().executedPlan().toString()
    assert one_day.count() == 4


def test_report_ids_do_not_change(spark):
    detected = spark.range(2).select(
        F.lit("box").alias("mailbox"), F.col("id").alias("key"),
        F.struct((F.col("id") == 1).alias("is_fraud")).alias("detection"),
    )
    build = lambda: R.build_reports(detected, "key", F.to_timestamp(F.lit("2024-01-01")))
    first = build().collect()
    assert len(first) == 1 and first == build().collect() and first[0]["status"] == "intercepted"


def test_report_ids_differ(spark):
    boxes = [("a", "b|c"), ("a|b", "c"), ("a", None), (None, "a"), (None, None), ("", ""), ("1:a", "b"), ("a", "1:b")]
    frame = spark.createDataFrame(boxes, "mailbox string, key string")
    ids = [r[0] for r in frame.select(R.report_id(F.col("mailbox"), F.col("key"))).collect()]
    assert len(set(ids)) == len(boxes)


def test_insert_if_absent(spark):
    known = registry(spark, "old")
    batch = spark.createDataFrame([(1, "new"), (2, "old"), (3, "  "), (4, "new"), (5, None), (None, "other")], "row long, email string")
    added, rejected = keyed.add_mailboxes(known, batch, "row", F.to_timestamp(F.lit("2024-01-01")))
    assert added.columns == schemas.MAILBOX.names
    assert [(r["email"], r["intercept_count"]) for r in added.collect()] == [("new", 0)]
    assert tuples(rejected.select("row", "reason")) == [(2, "exists"), (3, "blank"), (4, "exists"), (5, "blank"), (None, "no key")]


def test_insert_of_one_hot_address(spark):
    batch = spark.range(30_000).selectExpr("id AS row", "IF(id % 3 = 0, 'hot', concat('u', id)) AS email")
    added, rejected = keyed.add_mailboxes(registry(spark, "u1"), batch, "row", F.current_timestamp())
    assert added.count() == 20_000 and rejected.count() == 10_000


def test_delete_and_update(spark):
    known = registry(spark, "a", "b")
    keys = spark.createDataFrame([("b",), ("b",), ("z",)], "email string")
    kept, removed = keyed.remove_mailbox(known, keys)
    assert [r["email"] for r in kept.collect()] == ["a"] and removed.first()[0] == 1
    at = dt.datetime(2024, 1, 2)
    hits = spark.createDataFrame([("a", at), ("a", dt.datetime(2024, 1, 1)), ("z", at)], "mailbox string, at timestamp")
    updated = {r["email"]: (r["intercept_count"], r["last_checked"]) for r in keyed.update_mailbox(known, hits).collect()}
    assert updated == {"a": (3, at), "b": (1, None)}
    assert keyed.get_by_id(known, "email", "zz").count() == 0


FENCED = "前言\n" + fixed.ALERT_MARKER + "\n 请注意 \n" + fixed.ARCHIVE_MARKER + "\n```json\n%s\n```\n尾"


def test_replies(spark):
    good = FENCED % json.dumps({"fraud_type": "贷款诈骗", "confidence_avg": 0.965}, ensure_ascii=False)
    cases = [good, FENCED % "{'a': 1}", FENCED % "{", FENCED % '{"a": 1} rest', "没有代码块", None, "```json\n{\"fraud_type\": \"x\"}"]
    frame = spark.createDataFrame(list(enumerate(cases)), "k int, reply string")
    out = [(r["alert"], r["data"]) for r in replies.parse_responses(frame, "reply").orderBy("k").collect()]
    assert out[0][0] == "请注意" and out[0][1]["fraud_type"] == "贷款诈骗" and out[0][1]["confidence_avg"] == "0.965"
    for alert, data in (out[1], out[2], out[3], out[5]):
        assert alert == fixed.REPLY_UNAVAILABLE and data["error"] == fixed.BAD_JSON and data["fraud_type"] is None
    assert out[4][0] == "" and out[4][1]["content"] == "没有代码块"
    assert out[6][0] == "" and out[6][1]["fraud_type"] == "x"
    broken = ['{"fraud_type":"a"} x }', '{"a":1}{}', '{"a":1},"end":1}', '{"a":1}} {}', "[1]", ""]
    frame = spark.createDataFrame([(FENCED % x,) for x in broken], "reply string")
    assert {r["data"]["error"] for r in replies.parse_responses(frame, "reply").collect()} == {fixed.BAD_JSON}


def test_prompt_and_template(spark):
    frame = spark.createDataFrame(
        [("box", "bank", "冻结", "点击链接", "2024-03-24", (True, ["a"], {"a": (0.98, "贷款诈骗 (2)")})),
         ("box", "x", "y", "z", None, (False, [], {}))],
        "mailbox string, `from` string, subject string, body string, date string, "
        "detection struct<is_fraud:boolean,trigger_models:array<string>,details:map<string,struct<prob:double,type:string>>>",
    )
    at = F.to_timestamp(F.lit("2024-03-24 01:02:03"))
    prompts = [r["prompt"] for r in replies.build_prompts(frame, at).collect()]
    assert len(prompts) == 1
    assert "- 发件人: bank\n" in prompts[0] and "发送时间（2024-03-24）" in prompts[0] and '"prob": 0.98' in prompts[0]
    data = replies.template_report(frame, at, F.lit(0.98)).first()["data"]
    assert data["fraud_type"] == "贷款诈骗" and data["raw_content_summary"] == "点击链接..."
    assert data["intercept_time"] == "2024-03-24 01:02:03" and data["confidence_avg"] == "0.980000"
