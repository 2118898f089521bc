import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fraudwatch.functions import labels, scores as S
from fraudwatch.operators import ensemble, evaluate
from fraudwatch.plans import cascade as C, replies
from tests.conftest import tuples

NAMES = ["a", "b", "c"]


def scored(spark, *messages):
    """Messages from lists of (prob, type, error) per member."""
    rows = [
        (key, [(i, NAMES[i], p, t, e) for i, (p, t, e) in enumerate(members)]) for key, members in enumerate(messages)
    ]
    kind = "key int, scores array<struct<ord:int,model:string,prob:double,type:string,error:string>>"
    return spark.createDataFrame(rows, kind)


def test_threshold_edges(one):
    for prob, inclusive, strict in [(0.85, True, False), (0.8499999, False, False), (0.86, True, True)]:
        assert one(S.reaches(F.col("p")), p=prob) is inclusive
        assert one(S.reaches(F.col("p"), inclusive=False), p=prob) is strict
    assert one(S.reaches(F.col("p")), p=math.nan) is False
    assert one(S.reaches(F.col("p").cast("double")), p=None) is False


def test_verdict_skips_failed_members(spark):
    frame = scored(
        spark,
        [(None, None, "down"), (0.9, "贷款诈骗", None), (0.2, "客服诈骗", None)],
        [(None, None, "down"), (None, None, "down"), (None, None, "down")],
        [(math.nan, "x", None), (0.1, "y", None), (0.85, "z", None)],
    )
    out = {r["key"]: r["detection"] for r in ensemble.detect(frame, 3).collect()}
    assert out[0]["is_fraud"] and out[0]["trigger_models"] == ["b"] and list(out[0]["details"]) == ["b", "c"]
    assert not out[1]["is_fraud"] and out[1]["trigger_models"] == [] and out[1]["details"] == {}
    assert out[2]["is_fraud"] and out[2]["trigger_models"] == ["c"] and list(out[2]["details"]) == NAMES


def test_long_and_wide_votes_agree(spark):
    frame = scored(
        spark,
        [(0.1, "x", None), (0.9, "x", None), (None, None, "down")],
        [(0.1, "x", None), (0.2, "x", None), (0.3, "x", None)],
    )
    long = ensemble.to_long(frame, "key")
    assert tuples(ensemble.vote(long, "key")) == [(0, True), (1, False)]
    back = ensemble.from_long(spark.range(3).select(F.col("id").cast("int").alias("key")), long, "key", NAMES)
    voted = back.select("key", S.any_reaches(S.slots(F.col("scores"), 3)))
    assert tuples(voted) == [(0, True), (1, False), (2, False)]


@settings(max_examples=10, deadline=None)
@given(
    probs=st.lists(st.tuples(*[st.floats(0, 1)] * 3), min_size=1, max_size=20),
    low=st.floats(0, 1),
    high=st.floats(0, 1),
)
def test_vote_falls_with_the_threshold(spark, probs, low, high):
    low, high = sorted((low, high))
    frame = scored(spark, *[[(p, "x", None) for p in message] for message in probs])
    slots = S.slots(F.col("scores"), 3)
    rows = frame.select(
        F.greatest(*[s["prob"] for s in slots]).alias("top"),
        S.any_reaches(slots, low).alias("low"),
        S.any_reaches(slots, high).alias("high"),
    ).collect()
    for row in rows:
        assert row["low"] or not row["high"]
        assert row["high"] == (row["top"] >= high)


def test_strongest_model(spark):
    cases = spark.sql(
        "SELECT 0 k, map('x', named_struct('prob', 0.0D, 'type', 't')) m "
        "UNION ALL SELECT 1, map('b', named_struct('prob', 0.9D, 'type', 't'), 'a', named_struct('prob', 0.9D, 'type', 't')) "
        "UNION ALL SELECT 2, map('b', named_struct('prob', double('NaN'), 'type', 't'), 'c', named_struct('prob', 0.2D, 'type', 't'))"
    )
    best = cases.select("k", S.strongest(F.col("m"))["model"], S.strongest(F.col("m"))["prob"])
    assert tuples(best) == [(0, "AI检测", 0.0), (1, "a", 0.9), (2, "c", 0.2)]


def test_mean_confidence(spark):
    frame = scored(spark, [(0.2, "x", None), (0.4, "x", None), (None, None, "down")], [(None, None, "e")] * 3)
    mean = frame.select("key", F.round(S.mean_confidence(S.slots(F.col("scores"), 3)), 6))
    assert tuples(mean) == [(0, 0.3), (1, None)]


def test_detection_json(spark):
    frame = scored(spark, [(0.98, "贷款\"诈骗", None), (0.5, None, None), (None, None, "e")], [(None, None, "e")] * 3)
    texts = [r[0] for r in ensemble.detect(frame, 3).select(S.detection_json(F.col("detection"))).collect()]
    import json

    first = {"is_fraud": True, "trigger_models": ["a"],
             "details": {"a": {"prob": 0.98, "type": "贷款\"诈骗"}, "b": {"prob": 0.5, "type": None}}}
    assert texts[0] == json.dumps(first, indent=2, ensure_ascii=False)
    empty = {"is_fraud": False, "trigger_models": [], "details": {}}
    assert texts[1] == json.dumps(empty, indent=2, ensure_ascii=False)


def test_canonical_types_of_the_sample_counts(spark):
    """Counts of one sample archive: 20 reports under six spellings."""
    sample = {
        "冒充公检法及政府机关类": 11, "贷款诈骗": 3, "客服诈骗": 3,
        "熟人诈骗（冒充教育工作者+跨单位身份伪造）": 1, "熟人诈骗（冒充教育工作者+代购转账骗局）": 1,
        "熟人诈骗（冒充教育机构工作人员+代购转账类）": 1,
    }
    frame = spark.createDataFrame(list(sample.items()), "t string, n int")
    totals = frame.groupBy(labels.canonical_type(F.col("t")).alias("t")).agg(F.sum("n"))
    assert dict(tuples(totals)) == {"公检法诈骗": 11, "贷款诈骗": 3, "客服诈骗": 3, "熟人诈骗": 3}


def test_canonical_type_spellings(one):
    for raw, name in [("公检法诈骗 (1)", "公检法诈骗"), ("正常 (0)", "正常"), ("中奖", "其它诈骗"), (None, None)]:
        assert one(labels.canonical_type(F.col("t")), t=raw) == name


def test_missing_types(one):
    for raw, counted, shown in [(None, "未知诈骗", "疑似诈骗"), ("", "", "疑似诈骗"), ("x", "x", "x")]:
        assert one(labels.counted_type(F.col("t")), t=raw) == counted
        assert one(labels.shown_type(F.col("t")), t=raw) == shown


def test_generated_labels(one):
    cases = {
        "user 你好 assistant 贷款诈骗": (1.0, "贷款诈骗"),
        "assistant 这是诈骗": (1.0, "疑似诈骗"),
        "assistant 正常": (0.0, "正常"),
        "assistant 诈骗 assistant\n 属于客服诈骗　": (1.0, "属于客服诈骗"),
    }
    for answer, expected in cases.items():
        assert tuple(one(replies.parse_generated(F.col("a")), a=answer)) == expected


def test_cascade_edges(spark):
    frame = spark.createDataFrame([(0.85, 2), (0.8499999, 2), (math.nan, 2), (None, 2)], "p double, s int")
    both = [
        tuple(r) for r in frame.select(C.cascade(F.col("p"), F.col("s")), C.cascade(F.col("p"), F.col("s"), inclusive=False)).collect()
    ]
    assert both == [(3, 0), (0, 0), (0, 0), (0, 0)]


def test_softmax_and_argmax(one):
    assert abs(one(C.softmax_scam(F.lit(1.0), F.lit(2.0))) - math.exp(2) / (math.exp(1) + math.exp(2))) < 1e-12
    assert one(C.softmax_scam(F.lit(0.0), F.lit(5000.0))) == 1.0
    assert one(C.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1


def judged(spark):
    return spark.createDataFrame([(0, 0, "m1", 0), (0, 1, "m2", 1), (1, 1, "m3", 2), (2, 1, "m4", 3)],
                                 "t int, p int, content string, key int")


def test_evaluation_by_hand(spark):
    frame = judged(spark)
    cells = {(r["truth"], r["predicted"]): r["n"] for r in evaluate.confusion(frame, "t", "p", [0, 1, 2]).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 4 and cells[0, 1] == 1 and cells[2, 2] == 0
    report = {r["class"]: tuple(r)[1:] for r in evaluate.class_report(frame, "t", "p", [0, 1, 2]).collect()}
    assert report[0] == (1.0, 0.5, 0.6667, 2) and report[1] == (0.3333, 1.0, 0.5, 1) and report[2] == (0.0, 0.0, 0.0, 1)
    summary = {r["row"]: tuple(r)[1:] for r in evaluate.report_summary(frame, "t", "p", [0, 1, 2]).collect()}
    assert summary["accuracy"] == (0.5, 0.5, 0.5, 4)
    assert summary["macro avg"] == (0.4444, 0.5, 0.3889, 4)
    assert summary["weighted avg"] == (0.5833, 0.5, 0.4583, 4)
    assert evaluate.accuracy(frame, "t", "p").first()[0] == 0.5
    assert tuple(evaluate.false_positive_rate(frame, "t", "p").first()) == (2, 1, 0, 0.5)
    assert evaluate.false_positive_rate(frame.filter("t > 0"), "t", "p").first()["rate"] is None
    assert [tuple(r) for r in evaluate.fp_samples(frame, "t", "p", "key").collect()] == [(1, "m2...")]


def test_no_row_is_lost(spark):
    """A class outside the list and a missing prediction are errors, not absences."""
    frame = spark.createDataFrame([(0, 0), (0, 7), (1, None), (2, 2)], "t int, p int")
    cells = {(r["truth"], r["predicted"]): r["n"] for r in evaluate.confusion(frame, "t", "p", [0, 1, 2]).collect()}
    assert len(cells) == 11 and sum(cells.values()) == 4 and cells[0, 7] == 1 and cells[1, None] == 1
    summary = {r["row"]: tuple(r)[1:] for r in evaluate.report_summary(frame, "t", "p", [0, 1, 2]).collect()}
    assert summary["accuracy"] == (0.5, 0.5, 0.5, 4)
    assert evaluate.accuracy(frame, "t", "p").first()[0] == 0.5
    missing = spark.createDataFrame([(0, 0), (0, 1), (0, None)], "t int, p int")
    assert tuple(evaluate.false_positive_rate(missing, "t", "p").first()) == (3, 1, 1, 0.5)


def test_binary_confusion_at_the_threshold(spark):
    frame = spark.createDataFrame([(1, 0.85), (1, 0.2), (0, math.nan), (0, 0.9)], "t int, p double")
    cells = {(r["truth"], r["predicted"]): r["n"] for r in evaluate.binary_confusion(frame, "t", "p").collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}


def test_containment_accuracy(spark):
    pairs = spark.createDataFrame([("贷款", "贷款诈骗"), ("a", "b"), ("", "x")], "t string, p string")
    assert abs(evaluate.containment_accuracy(pairs, "t", "p").first()[0] - 2 / 3) < 1e-12
    assert evaluate.containment_accuracy(pairs.filter("t = 'none'"), "t", "p").first()[0] == 0.0
