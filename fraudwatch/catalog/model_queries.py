"""Member queries (M1–M4, M7, M8, E1, S9): fitted on the driver's tables with their defaults.

What a fitted member says of a message has no SQL form, so those queries return it
without one.  SQL states what must hold of every member: how many messages it judged,
that its accuracy is the share of right ones and above that of the largest class.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from fraudwatch import fixed
from fraudwatch.catalog.corpus_queries import MAX_TERMS, TAIL, parts
from fraudwatch.catalog.inputs import MSG, messages, table
from fraudwatch.catalog.registry import query
from fraudwatch.functions import labels
from fraudwatch.operators import ensemble, evaluate, splits
from fraudwatch.plans import members
from fraudwatch.sources import store
from fraudwatch.session import new_path

_fitted: dict = {}


def _once(spark, folder, name, fit):
    """Fit a member once per session and folder; several queries score with it."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _fitted:
        _fitted[key] = fit()
    return _fitted[key]


def boosted(spark, folder) -> members.BoostedMember:
    train = lambda: parts(spark, folder)[0]
    return _once(spark, folder, "boosted", lambda: members.fit_boosted(train(), "msg_key", "content", max_terms=MAX_TERMS))


def presence(spark, folder) -> members.PresenceMember:
    train = lambda: parts(spark, folder)[0]
    return _once(spark, folder, "presence", lambda: members.fit_presence(
        train(), "content"))


def vectors(spark, folder) -> DataFrame:
    """Embeddings as a corpus: label 0 is normal, all others fall into four classes."""
    label = F.col("label")
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("msg_key"), "embedding",
        F.when(label == 0, 0).otherwise((label - 1) % 4 + 1).cast("int").alias("class_id"),
    )
    return splits.split_tail(rows, "class_id", "msg_key")


def semantic(spark, folder) -> members.Member:
    train = vectors(spark, folder).filter("split = 'train'")
    return _once(spark, folder, "semantic", lambda: members.fit_semantic(train, "embedding", embedded=True))


def semantic_text(spark, folder) -> members.Member:
    train = lambda: parts(spark, folder)[0]
    return _once(spark, folder, "semantic_text", lambda: members.fit_semantic(train(), "content"))


def labelled_vectors(spark, folder) -> DataFrame:
    """Embeddings with text labels: label 0 is normal, the nine others have names of their own."""
    label = F.col("label")
    named = F.when(label == 0, "正常").otherwise(F.concat(F.lit("骗局"), label.cast("string")))
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("msg_key"), "embedding", named.alias("label"))
    return splits.split_tail(rows, "label", "msg_key")


def labelled(spark, folder) -> members.Member:
    """A member with an open set of labels, saved and loaded again."""

    def fit():
        train = labelled_vectors(spark, folder).filter("split = 'train'")
        path = new_path(spark, "bundle")
        members.fit_semantic(train, "embedding", embedded=True, key="msg_key", label="label", normal="正常").save(path)
        return members.Member.load(spark, path)

    return _once(spark, folder, "labelled", fit)


def _judged(member, rows):
    return member.predict(rows).select("msg_key", "class_id", F.round("prob", 6).alias("prob"), "stage2", "predicted")


@query("m1_stage1")
def m1_stage1(spark, folder):
    rows = boosted(spark, folder).score(parts(spark, folder)[1])
    return rows.select("msg_key", "class_id", F.round("prob", 6).alias("prob"))


@query("m2_stage2")
def m2_stage2(spark, folder):
    rows = boosted(spark, folder).score(parts(spark, folder)[1])
    return rows.select("msg_key", "class_id", "stage2")


@query("m2_open_labels")
def m2_open_labels(spark, folder):
    """Classes with text labels, named by a bundle that was saved and loaded."""
    test = labelled_vectors(spark, folder).filter("split = 'test'")
    judged = labelled(spark, folder).predict(test)
    return judged.select("msg_key", "label", F.round("prob", 6).alias("prob"), "predicted", "predicted_label")


@query("m3_presence")
def m3_presence(spark, folder):
    return _judged(presence(spark, folder), parts(spark, folder)[1])


@query("m4_semantic")
def m4_semantic(spark, folder):
    return _judged(semantic(spark, folder), vectors(spark, folder).filter("split = 'test'"))


VECTOR_TEST = """WITH v AS (SELECT vec_id AS msg_key, CASE WHEN label = 0 THEN 0 ELSE (label - 1) % 4 + 1 END AS class_id FROM embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY msg_key) AS rn, count(*) OVER (PARTITION BY class_id) AS n FROM v)"""


@query(
    "m4_semantic_rules",
    f"{VECTOR_TEST} SELECT msg_key, class_id, TRUE AS in_range, TRUE AS named, TRUE AS by_rule FROM r WHERE rn > n - floor(n * 0.1::DOUBLE)",
)
def m4_semantic_rules(spark, folder):
    """What SQL can say of every judgement of m4_semantic: the probability and the class are in range, and the rule gives the class."""
    judged = m4_semantic(spark, folder)
    by_rule = F.when(F.col("prob") >= fixed.FRAUD_THRESHOLD, F.col("stage2") + 1).otherwise(0)
    # Rounded probabilities this close to the threshold could fall on either side of it.
    close = F.abs(F.col("prob") - fixed.FRAUD_THRESHOLD) <= 1e-6
    return judged.select(
        "msg_key", "class_id", F.col("prob").between(0, 1).alias("in_range"), F.col("stage2").between(0, 3).alias("named"),
        (close | (F.col("predicted") == by_rule)).alias("by_rule"),
    )


@query(
    "v4_semantic_member",
    f"""{VECTOR_TEST} SELECT count(*) AS support, TRUE AS accuracy_agrees, count(*) FILTER (WHERE class_id = 0) AS normals, 0 AS missing
        FROM r WHERE rn > n - floor(n * 0.1::DOUBLE)""",
)
def v4_semantic_member(spark, folder):
    """The vector member on merged classes, judged on its test part as v4_fitted_members judges the others."""
    judged = m4_semantic(spark, folder).select("class_id", "predicted")
    hits = F.count_if(F.col("class_id") == F.col("predicted"))
    seen = judged.agg(F.count(F.lit(1)).alias("support"), hits.alias("hits"))
    found = seen.crossJoin(evaluate.accuracy(judged, "class_id", "predicted")).crossJoin(  # one row each
        evaluate.false_positive_rate(judged, "class_id", "predicted"))
    agrees = F.abs(F.col("accuracy") - F.col("hits") / F.col("support")) < 1e-9
    return found.select("support", agrees.alias("accuracy_agrees"), "normals", "missing")


@query("m4_semantic_text")
def m4_semantic_text(spark, folder):
    """Character vectors learned from the texts."""
    return _judged(semantic_text(spark, folder), parts(spark, folder)[1])


@query(
    "m8_score_batch",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)
       SELECT vec_id, round(1 / (1 + exp(-sum(CAST(x AS DOUBLE) * (i % 5 - 2)))), 6) AS prob FROM e GROUP BY vec_id""",
)
def m8_score_batch(spark, folder):
    rows = table(spark, folder, "embeddings")

    def linear_model():
        """Stand-in for a caller's model: fixed weights over 64 inputs."""
        weights = np.arange(64) % 5 - 2.0
        return lambda inputs: 1.0 / (1.0 + np.exp(-(inputs.astype(np.float64) @ weights)))

    scored = members.score_batch(rows, [F.col("embedding")], linear_model, T.DoubleType(), shapes=[[64]])
    return scored.select("vec_id", F.round("prob", 6).alias("prob"))


@query("m7_cascade_models")
def m7_cascade_models(spark, folder):
    """The boosted cascade over the test part, as prediction rows."""
    judged = boosted(spark, folder).predict(parts(spark, folder)[1])
    return judged.select("msg_key", "class_id", F.round("prob", 6).alias("prob"), "stage2", "predicted", "predicted_label")


@query("v2_boosted_report")
def v2_boosted_report(spark, folder):
    """Train, cascade, prediction file, and the report over what the file holds."""
    judged = boosted(spark, folder).predict(parts(spark, folder)[1])
    path = new_path(spark, "predictions")
    truth = labels.class_name(F.col("class_id"))
    store.write_predictions(judged.select("content", truth.alias("fine_label"), "predicted_label", F.col("prob").alias("stage1_fraud_prob")), path)
    return evaluate.class_report(store.read_predictions(spark, path), "fine_label", "predicted_label", fixed.CLASS_NAMES)


@query("e1_member_ensemble")
def e1_member_ensemble(spark, folder):
    """Three fitted members score the same messages; the OR vote decides and names those that triggered it."""
    fitted = {"boosted": boosted(spark, folder), "presence": presence(spark, folder), "semantic": semantic_text(spark, folder)}
    detected = ensemble.detect(members.score_members(parts(spark, folder)[1], fitted), len(fitted))
    found = F.col("detection")
    return detected.select(
        "msg_key", "class_id", found["is_fraud"].alias("is_fraud"), F.array_join(found["trigger_models"], ",").alias("trigger_models"),
        *(F.round(F.get("scores", F.lit(i))["prob"], 6).alias(name) for i, name in enumerate(fitted)),
    )


def odd_model():
    """Stand-in for a caller's model that cannot read some messages: algebra on the number in a message."""

    def judge(messages):
        out = []
        for props in messages:
            k = int("".join(c for c in props if c.isdigit()))
            if k % 7 == 0:
                raise ValueError(f"cannot read {k}")
            out.append((k / 100, "贷款诈骗" if k % 2 else None))
        return out

    return judge


@query(
    "e5_guarded_member",
    f"""WITH {MSG} SELECT msg_key, CASE WHEN k % 7 <> 0 THEN k / 100.0::DOUBLE END AS prob,
          CASE WHEN k % 7 <> 0 AND k % 2 = 1 THEN '贷款诈骗' END AS type, CASE WHEN k % 7 = 0 THEN 'ValueError: cannot read ' || k END AS error
        FROM msg""",
)
def e5_guarded_member(spark, folder):
    """A caller's model raises on one message in seven: those alone have no score."""
    called = members.score_guarded(messages(spark, folder), F.col("props"), odd_model)
    return called.select("msg_key", "scored.*")


@query(
    "e1_four_members",
    f"""WITH {MSG}, a AS (SELECT msg_key, CASE event_type WHEN 'click' THEN '贷款诈骗' WHEN 'purchase' THEN '电信诈骗' WHEN 'view' THEN '正常' END AS t FROM msg),
          s AS (SELECT msg_key, CASE WHEN k % 7 <> 0 THEN k / 100.0::DOUBLE END AS p1, CASE WHEN k % 7 = 0 THEN TRUE ELSE FALSE END AS failed,
              CASE WHEN t IS NULL THEN NULL WHEN contains(t, '诈骗') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p3,
              CASE WHEN contains(t, '贷款诈骗') THEN t WHEN contains(t, '诈骗') THEN '疑似诈骗' WHEN t IS NOT NULL THEN '正常' END AS type3
            FROM msg JOIN a USING (msg_key))
        SELECT msg_key, coalesce(p1 >= 0.85, FALSE) OR coalesce(p3 >= 0.85, FALSE) AS is_fraud, type3 AS answered_type,
          concat_ws(',', CASE WHEN p1 >= 0.85 THEN 'called' END, CASE WHEN p3 >= 0.85 THEN 'generated' END) AS trigger_models,
          1 + failed::INT AS failed_members, coalesce(p1 >= 0.85, FALSE) AS is_fraud_without_answers FROM s""",
)
def e1_four_members(spark, folder):
    """A caller's model, one that did not load, and generated answers as the optional member, in one vote."""
    rows = messages(spark, folder)
    answer = (
        F.when(F.col("event_type") == "click", "贷款诈骗").when(F.col("event_type") == "purchase", "电信诈骗")
        .when(F.col("event_type") == "view", "正常")
    )
    answers = rows.select("msg_key", F.concat(F.lit("user\nassistant\n"), answer).alias("answer")).where("answer IS NOT NULL")
    voters = {
        "called": members.CalledMember("called", "props", odd_model), "lost": "OSError: no bundle",
        "generated": members.AnswerMember("generated", answers, "msg_key"),
    }
    voted = ensemble.detect(members.score_members(rows.select("msg_key", "props"), voters), len(voters))
    fewer = ensemble.detect(members.score_members(rows.select("msg_key", "props"), voters, ["called", "lost"]), 2)
    errors = [F.get("scores", F.lit(i))["error"].isNotNull().cast("int") for i in range(3)]
    told = voted.select(
        "msg_key", F.col("detection.is_fraud").alias("is_fraud"), F.array_join("detection.trigger_models", ",").alias("trigger_models"),
        F.get("scores", F.lit(2))["type"].alias("answered_type"), (errors[0] + errors[1] + errors[2]).alias("failed_members"))
    return told.join(fewer.select("msg_key", F.col("detection.is_fraud").alias("is_fraud_without_answers")), "msg_key")


FITTED_SQL = f"""WITH {TAIL}, t AS (SELECT class_id FROM tail WHERE split = 'test'),
  v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
  m AS (
    SELECT unnest(['boosted', 'presence', 'semantic_text']) AS member, class_id FROM t
    UNION ALL SELECT 'labelled', label FROM v WHERE rn > n - floor(n * 0.1::DOUBLE))
  SELECT member, count(*) AS support, TRUE AS accuracy_agrees, TRUE AS above_majority, count(*) FILTER (WHERE class_id = 0) AS normals,
    0 AS missing FROM m GROUP BY member"""


@query("v4_fitted_members", FITTED_SQL)
def v4_fitted_members(spark, folder):
    """Train, cascade, evaluate: members of every kind judged on their test parts."""
    test = parts(spark, folder)[1]
    judged = {
        "boosted": boosted(spark, folder).predict(test), "presence": presence(spark, folder).predict(test),
        "semantic_text": semantic_text(spark, folder).predict(test),
        "labelled": labelled(spark, folder).predict(labelled_vectors(spark, folder).filter("split = 'test'")).withColumn(
            "class_id", F.when(F.col("label") == F.col("predicted_label"), F.col("predicted")).otherwise(
                F.when(F.col("label") == "正常", 0).otherwise(F.regexp_extract("label", "[0-9]+", 0).cast("int") + 100))),
    }
    out = None
    for name, rows in judged.items():
        rows = rows.select("class_id", "predicted")
        hits = F.count_if(F.col("class_id") == F.col("predicted"))
        # The largest class: classes are few, and rights are counted in the same pass.
        sizes = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"))
        seen = sizes.agg(F.sum("n").alias("support"), F.sum("hits").alias("hits"), F.max("n").alias("largest"))
        found = seen.crossJoin(evaluate.accuracy(rows, "class_id", "predicted")).crossJoin(  # one row each
            evaluate.false_positive_rate(rows, "class_id", "predicted"))
        agrees = F.abs(F.col("accuracy") - F.col("hits") / F.col("support")) < 1e-9
        told = found.select(
            F.lit(name).alias("member"), "support", agrees.alias("accuracy_agrees"), (F.col("hits") > F.col("largest")).alias("above_majority"),
            "normals", "missing")
        out = told if out is None else out.unionByName(told)
    return out


@query("s9_bundle", f"WITH {TAIL} SELECT msg_key, TRUE AS same FROM tail WHERE split = 'test'")
def s9_bundle(spark, folder):
    """Saved and loaded again: scores must not change."""
    fitted, path = presence(spark, folder), new_path(spark, "bundle")
    fitted.save(path)
    test = parts(spark, folder)[1]
    before = _judged(fitted, test).select("msg_key", F.col("prob").alias("before"))
    after = _judged(members.Member.load(spark, path), test).select("msg_key", F.col("prob").alias("after"))
    return before.join(after, "msg_key").select("msg_key", (F.col("before") == F.col("after")).alias("same"))
