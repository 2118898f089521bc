"""Ensemble, cascade and evaluation queries (E, M5–M7, V)."""

from pyspark.sql import functions as F

from fraudwatch.catalog.inputs import (
    ARCHIVED_TYPE, MEMBERS, MSG, PRED_SQL, REP, SCORE, choose, messages, reports, scored, slots, table,
)
from fraudwatch.catalog.registry import query
from fraudwatch.functions import labels, scores as S
from fraudwatch.operators import ensemble, evaluate
from fraudwatch.plans import cascade as C, replies

SIX = lambda column, name: F.round(column, 6).alias(name)


@query("e1_score_all", f"WITH {SCORE} SELECT msg_key, ord, model, round(prob, 6) AS prob, type, error FROM score")
def e1_score_all(spark, folder):
    long = ensemble.to_long(scored(spark, folder), "msg_key")
    return long.select("msg_key", "ord", "model", SIX("prob", "prob"), "type", "error")


@query(
    "e2_vote",
    f"WITH {SCORE} SELECT msg_key, bool_or(coalesce(prob >= 0.85, FALSE)) AS is_fraud FROM score GROUP BY msg_key",
)
def e2_vote(spark, folder):
    return scored(spark, folder).select("msg_key", S.any_reaches(slots()).alias("is_fraud"))


@query(
    "e2_vote_long",
    f"WITH {SCORE} SELECT msg_key, bool_or(coalesce(prob >= 0.85, FALSE)) AS is_fraud FROM score GROUP BY msg_key",
)
def e2_vote_long(spark, folder):
    return ensemble.vote(ensemble.to_long(scored(spark, folder), "msg_key"), "msg_key")


@query(
    "e3_triggers",
    f"""WITH {SCORE} SELECT msg_key, coalesce(string_agg(model, ',' ORDER BY ord)
        FILTER (WHERE prob >= 0.85), '') AS trigger_models FROM score GROUP BY msg_key""",
)
def e3_triggers(spark, folder):
    return scored(spark, folder).select(
        "msg_key", F.array_join(S.trigger_models(slots()), ",").alias("trigger_models")
    )


@query(
    "e4_details",
    f"""WITH {SCORE} SELECT msg_key, model, round(prob, 6) AS prob, type
        FROM score WHERE error IS NULL""",
)
def e4_details(spark, folder):
    detected = ensemble.detect(scored(spark, folder), len(MEMBERS))
    exploded = detected.select("msg_key", F.explode_outer("detection.details").alias("model", "d"))
    return exploded.select("msg_key", "model", SIX("d.prob", "prob"), F.col("d.type").alias("type"))


@query(
    "e5_failed_member",
    f"""WITH {SCORE} SELECT m.msg_key, coalesce(bool_or(s.prob >= 0.85), FALSE) AS is_fraud, count(s.model) AS voters
        FROM msg m LEFT JOIN score s ON s.msg_key = m.msg_key AND s.error IS NULL AND m.event_type <> 'view'
        GROUP BY m.msg_key""",
)
def e5_failed_member(spark, folder):
    """Scores stored by separate jobs; nobody scored the ``view`` messages."""
    all_messages = messages(spark, folder)
    long = ensemble.to_long(scored(spark, folder).filter("event_type <> 'view'"), "msg_key")
    gathered = ensemble.from_long(all_messages.select("msg_key"), long, "msg_key", MEMBERS)
    return gathered.select(
        "msg_key",
        S.any_reaches(slots()).alias("is_fraud"),
        S.voters(slots()).cast("bigint").alias("voters"),
    )


@query(
    "e6_members",
    f"""WITH {SCORE} SELECT msg_key, bool_or(coalesce(prob >= 0.85, FALSE)) AS is_fraud
        FROM score WHERE model IN ('boosted', 'semantic') GROUP BY msg_key""",
)
def e6_members(spark, folder):
    chosen = scored(spark, folder, ["boosted", "semantic"])
    voted = S.any_reaches(S.slots(F.col("scores"), 2))
    return chosen.select("msg_key", voted.alias("is_fraud"))


CANONICAL_SQL = """CASE WHEN contains(t, '公检法') OR contains(t, '政府机关') THEN '公检法诈骗'
  WHEN contains(t, '贷款') THEN '贷款诈骗' WHEN contains(t, '客服') THEN '客服诈骗'
  WHEN contains(t, '熟人') OR contains(t, '领导') THEN '熟人诈骗' WHEN contains(t, '正常') THEN '正常'
  WHEN t IS NOT NULL THEN '其它诈骗' END"""


@query(
    "e7_canonical_type",
    f"""WITH {SCORE}, raw AS (SELECT type AS t FROM score UNION ALL SELECT ftype FROM msg UNION ALL SELECT props FROM msg)
        SELECT t AS raw_type, {CANONICAL_SQL} AS canonical_type, count(*) AS n FROM raw GROUP BY 1, 2""",
)
def e7_canonical_type(spark, folder):
    source = scored(spark, folder)
    raw = (
        source.select(F.explode("scores.type").alias("t"))
        .unionAll(source.select(choose("event_type", ARCHIVED_TYPE)))
        .unionAll(source.select("props"))
    )
    named = raw.groupBy(F.col("t").alias("raw_type")).agg(F.count(F.lit(1)).alias("n"))
    return named.select("raw_type", labels.canonical_type(F.col("raw_type")).alias("canonical_type"), "n")


LONG_REP = f"""{REP}, live AS (
  SELECT id, mailbox, 'boosted' AS model, p0 AS prob FROM rep UNION ALL
  SELECT id, mailbox, 'presence', p1 FROM rep WHERE p1 IS NOT NULL UNION ALL
  SELECT id, mailbox, 'semantic', p2 FROM rep)"""


@query(
    "e8_top_model",
    f"""WITH {LONG_REP}, ranked AS (SELECT id, mailbox, model, prob,
          row_number() OVER (PARTITION BY id ORDER BY prob DESC, model) AS rn FROM live WHERE prob > 0)
        SELECT id, mailbox, model, round(prob, 6) AS prob FROM ranked WHERE rn = 1""",
)
def e8_top_model(spark, folder):
    return ensemble.top_model(reports(spark, folder)).withColumn("prob", F.round("prob", 6))


@query(
    "e9_confidence",
    f"WITH {SCORE} SELECT msg_key, round(avg(prob), 6) AS confidence_avg FROM score WHERE error IS NULL GROUP BY msg_key",
)
def e9_confidence(spark, folder):
    return scored(spark, folder).select("msg_key", SIX(S.mean_confidence(slots()), "confidence_avg"))


@query("e10_score_flags", f"WITH {LONG_REP} SELECT id, model, round(prob, 6) AS prob, prob > 0.85 AS high FROM live")
def e10_score_flags(spark, folder):
    return ensemble.score_flags(reports(spark, folder)).withColumn("prob", F.round("prob", 6))


@query(
    "m5_parse_generated",
    f"""WITH {MSG}, answer AS (SELECT msg_key, trim(CASE event_type WHEN 'click' THEN tname WHEN 'purchase' THEN '这是' || tname
            WHEN 'view' THEN '电信诈骗' WHEN 'signup' THEN '正常' ELSE '' END, ' ' || chr(10)) AS t FROM msg)
        SELECT msg_key, CASE WHEN contains(t, '诈骗') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prob,
          CASE WHEN contains(t, '公检法诈骗') OR contains(t, '贷款诈骗') OR contains(t, '客服诈骗') OR contains(t, '熟人诈骗') THEN t
               WHEN contains(t, '诈骗') THEN '疑似诈骗' ELSE '正常' END AS type FROM answer""",
)
def m5_parse_generated(spark, folder):
    answer = (
        F.when(F.col("event_type") == "click", labels.class_name(F.col("class_id")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("这是"), labels.class_name(F.col("class_id"))))
        .when(F.col("event_type") == "view", F.lit("电信诈骗"))
        .when(F.col("event_type") == "signup", F.lit("正常"))
        .otherwise(F.lit(""))
    )
    text = F.concat(F.lit("user\n"), F.col("props"), F.lit("\nassistant\n"), answer, F.lit(" \n"))
    return messages(spark, folder).select("msg_key", F.inline_outer(F.array(replies.parse_generated(text))))


@query(
    "m6_argmax",
    """SELECT vec_id, round(1 / (1 + exp(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE))), 6) AS prob,
         list_position(embedding, list_max(embedding)) - 1 AS top FROM embeddings""",
)
def m6_argmax(spark, folder):
    vector = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        SIX(C.softmax_scam(F.get(vector, F.lit(0)), F.get(vector, F.lit(1))), "prob"),
        C.argmax(vector).alias("top"),
    )


def predicted(spark, folder):
    """Events with their class and the class a stand-in cascade predicts."""
    value = F.col("value")
    source = messages(spark, folder).withColumn("prob", value / (value + 5))
    stage2 = F.floor(F.col("k") / 25).cast("int")
    return source.withColumn("predicted", C.cascade(F.col("prob"), stage2)).withColumn("content", F.col("props"))



@query("m7_cascade", f"WITH {PRED_SQL} SELECT msg_key, class_id, predicted FROM pred")
def m7_cascade(spark, folder):
    return predicted(spark, folder).select("msg_key", "class_id", "predicted")


@query(
    "m7_cascade_strict",
    f"WITH {MSG} SELECT msg_key, CASE WHEN k / 100.0::DOUBLE > 0.85 THEN 1 ELSE 0 END AS predicted FROM msg",
)
def m7_cascade_strict(spark, folder):
    """The strict variant; one message in a hundred sits exactly on the threshold."""
    strict = C.cascade(F.col("k") / F.lit(100.0), F.lit(0), inclusive=False)
    return messages(spark, folder).select("msg_key", strict.alias("predicted"))


CLASSES = [0, 1, 2, 3, 4]
CELLS = f"""{PRED_SQL}, cell AS (SELECT t.c AS truth, p.c AS predicted,
    (SELECT count(*) FROM pred WHERE class_id = t.c AND predicted = p.c) AS n
  FROM (SELECT unnest([0, 1, 2, 3, 4]) AS c) t, (SELECT unnest([0, 1, 2, 3, 4]) AS c) p)"""
RATES = f"""{CELLS}, tot AS (SELECT c.truth AS class,
    CAST(sum(CASE WHEN c.predicted = c.truth THEN n ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(n) AS BIGINT) AS support,
    (SELECT CAST(sum(n) AS DOUBLE) FROM cell x WHERE x.predicted = c.truth) AS named FROM cell c GROUP BY c.truth),
  pr AS (SELECT class, tp, support, CASE WHEN named > 0 THEN tp / named ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM tot),
  rate AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
    FROM pr)"""


@query("v1_confusion", f"WITH {CELLS} SELECT truth, predicted, n FROM cell")
def v1_confusion(spark, folder):
    return evaluate.confusion(predicted(spark, folder), "class_id", "predicted", CLASSES)


@query(
    "v2_class_report",
    f"""WITH {RATES} SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
        support FROM rate""",
)
def v2_class_report(spark, folder):
    return evaluate.class_report(predicted(spark, folder), "class_id", "predicted", CLASSES)


@query(
    "v3_report_summary",
    f"""WITH {RATES}, one AS (SELECT sum(tp) / sum(support) AS acc, CAST(sum(support) AS BIGINT) AS support,
          avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(precision * support) / sum(support) AS wp,
          sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM rate)
        SELECT 'accuracy' AS row, round(acc, 4) AS precision, round(acc, 4) AS recall, round(acc, 4) AS f1, support FROM one
        UNION ALL SELECT 'macro avg', round(mp, 4), round(mr, 4), round(mf, 4), support FROM one
        UNION ALL SELECT 'weighted avg', round(wp, 4), round(wr, 4), round(wf, 4), support FROM one""",
)
def v3_report_summary(spark, folder):
    return evaluate.report_summary(predicted(spark, folder), "class_id", "predicted", CLASSES)


@query(
    "v4_accuracy",
    f"WITH {PRED_SQL} SELECT round(avg(CASE WHEN class_id = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM pred",
)
def v4_accuracy(spark, folder):
    return evaluate.accuracy(predicted(spark, folder), "class_id", "predicted").select(SIX("accuracy", "accuracy"))


@query(
    "v5_false_positive_rate",
    f"""WITH {PRED_SQL} SELECT count(*) FILTER (WHERE class_id = 0) AS normals,
          count(*) FILTER (WHERE class_id = 0 AND predicted <> 0) AS false_positives,
          count(*) FILTER (WHERE class_id = 0 AND predicted IS NULL) AS missing,
          round(count(*) FILTER (WHERE class_id = 0 AND predicted <> 0)::DOUBLE / count(*) FILTER (WHERE class_id = 0), 6) AS rate
        FROM pred""",
)
def v5_false_positive_rate(spark, folder):
    rate = evaluate.false_positive_rate(predicted(spark, folder), "class_id", "predicted")
    return rate.withColumn("rate", F.round("rate", 6))


@query(
    "v6_fp_samples",
    f"""WITH {PRED_SQL} SELECT msg_key, substr(props, 1, 60) || '...' AS preview FROM pred
        WHERE class_id = 0 AND predicted <> 0 ORDER BY msg_key LIMIT 5""",
)
def v6_fp_samples(spark, folder):
    return evaluate.fp_samples(predicted(spark, folder), "class_id", "predicted", "msg_key")


@query(
    "v7_binary_confusion",
    f"""WITH {MSG} SELECT t.c AS truth, p.c AS predicted, (SELECT count(*) FROM msg
          WHERE CAST(class_id <> 0 AS INTEGER) = t.c AND CAST(p0 >= 0.85 AS INTEGER) = p.c) AS n
        FROM (SELECT unnest([0, 1]) AS c) t, (SELECT unnest([0, 1]) AS c) p""",
)
def v7_binary_confusion(spark, folder):
    truth = predicted(spark, folder).withColumn("stage1_label", labels.stage1_label(F.col("class_id")))
    return evaluate.binary_confusion(truth, "stage1_label", "prob")


@query(
    "v8_containment_accuracy",
    f"""WITH {MSG}, pair AS (SELECT tname AS a, CASE WHEN k % 7 = 0 THEN '' ELSE coalesce(ftype, '正常短信') END AS b FROM msg)
        SELECT round(avg(CASE WHEN contains(a, b) OR contains(b, a) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM pair""",
)
def v8_containment_accuracy(spark, folder):
    said = F.when(F.col("k") % 7 == 0, "").otherwise(choose("event_type", ARCHIVED_TYPE, "正常短信"))
    pairs = messages(spark, folder).select(labels.class_name(F.col("class_id")).alias("truth"), said.alias("said"))
    return evaluate.containment_accuracy(pairs, "truth", "said").select(SIX("accuracy", "accuracy"))


LOOSE = f"""{PRED_SQL}, loose AS (SELECT class_id AS t, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 9 ELSE predicted END AS p FROM pred)"""


def loose(spark, folder):
    """Predictions of which some are missing and some name a class that nobody listed."""
    kind = F.col("event_type")
    changed = F.when(kind == "signup", 9).when(kind != "error", F.col("predicted"))
    return predicted(spark, folder).select(F.col("class_id").alias("t"), changed.alias("p"))


@query(
    "v1_any_class",
    f"""WITH {LOOSE}, c AS (SELECT t, p, count(*) AS n FROM loose GROUP BY t, p),
          g AS (SELECT a.i AS t, b.i AS p FROM range(5) a(i), range(5) b(i))
        SELECT coalesce(c.t, g.t)::INT AS truth, CASE WHEN g.t IS NULL THEN c.p ELSE g.p END::INT AS predicted, coalesce(n, 0) AS n
        FROM g FULL JOIN c ON c.t = g.t AND c.p = g.p""",
)
def v1_any_class(spark, folder):
    return evaluate.confusion(loose(spark, folder), "t", "p", list(range(5)))


@query(
    "v3_any_class",
    f"""WITH {LOOSE} SELECT count(*) AS support, round(avg(CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy,
          count(*) FILTER (WHERE t = 0) AS normals, count(*) FILTER (WHERE t = 0 AND p <> 0) AS false_positives,
          count(*) FILTER (WHERE t = 0 AND p IS NULL) AS missing FROM loose""",
)
def v3_any_class(spark, folder):
    rows = loose(spark, folder)
    found = evaluate.report_summary(rows, "t", "p", list(range(5))).filter("row = 'accuracy'")
    rate = evaluate.false_positive_rate(rows, "t", "p").drop("rate")
    return found.select("support", F.col("precision").alias("accuracy"), F.lit(1).alias("one")).join(rate.withColumn("one", F.lit(1)), "one").drop("one")
