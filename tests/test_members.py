"""Fitted members: floors against the majority class, and saved copies."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F, types as T

from fraudwatch.functions import grams
from fraudwatch.operators import ensemble, evaluate, splits
from fraudwatch.plans import boosting, linear, members, vectors
from fraudwatch.session import new_path

WORDS = {0: "明天开会记得带材料", 1: "公安局通知你涉嫌洗钱", 2: "低息贷款无需抵押", 3: "客服退款请点链接", 4: "我是领导急需转账"}


@pytest.fixture(scope="module")
def corpus(spark):
    """Each class has words of its own, mixed with shared filler."""
    filler = "你好请问今天的天气怎么样谢谢"
    rows = []
    for key in range(300):
        number = key % 5 if key % 2 else 0
        word = WORDS[number]
        rows.append((key, filler[key % 7 : key % 7 + 5] + word[key % 4 :] + filler[: key % 6], number))
    frame = spark.createDataFrame(rows, "msg_key long, content string, class_id int").repartition(4)
    return splits.split_tail(frame, "class_id", "msg_key", 0.2)


def floors(member, corpus):
    test = corpus.filter("split = 'test'")
    judged = member.predict(test).cache()
    majority = test.agg(F.avg((F.col("class_id") == 0).cast("double"))).first()[0]
    assert evaluate.accuracy(judged, "class_id", "predicted").first()[0] > max(majority, 0.8)
    assert judged.filter("prob < 0 OR prob > 1 OR stage2 NOT BETWEEN 0 AND 3").count() == 0
    assert judged.filter("(prob >= 0.85) <> (predicted > 0)").count() == 0


def test_boosted(spark, corpus):
    """All 300 and 150 rounds; a saved copy scores alike, and so does a fit of the same rows in other partitions."""
    train = corpus.filter("split = 'train'")
    member = members.fit_boosted(train, "msg_key", "content")
    floors(member, corpus)
    assert sum(len(p[0]) for p in member.stage1.passes) == 300 and sum(len(p[0]) for p in member.stage2.passes) == 4 * 150
    path = new_path(spark, "bundle")
    member.save(path)
    again = members.Member.load(spark, path)
    other = members.fit_boosted(train.repartition(7), "msg_key", "content")
    scores = lambda m: {r["msg_key"]: (r["prob"], r["stage2"]) for r in m.score(corpus).collect()}
    assert again.params == member.params and scores(again) == scores(member) == scores(other)


def test_boosting_on_a_bounded_sample(spark, corpus):
    member = members.fit_boosted(corpus.filter("split = 'train'"), "msg_key", "content", rounds1=40, rounds2=20, fit_rows=180)
    judged = member.predict(corpus.filter("split = 'test'"))
    assert evaluate.accuracy(judged, "class_id", "predicted").first()[0] > 0.6


def test_boosting_of_nothing(spark, corpus):
    """No rows, or rows of one class, give a member that scores without failing."""
    none = members.fit_boosted(corpus.where("false"), "msg_key", "content", rounds1=5, rounds2=5)
    normal = members.fit_boosted(corpus.where("class_id = 0"), "msg_key", "content", rounds1=5, rounds2=5)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "天" * 5000)], "msg_key long, content string")
    assert [0 <= r["prob"] <= 1 for r in none.score(odd).collect()] == [True] * 3
    assert all(r["prob"] < 0.5 for r in normal.score(odd).collect())


def test_tree_against_an_exhaustive_search():
    """The first cut of a tree is the best one, and leaves hold the Newton step of their rows."""
    rng = np.random.default_rng(5)
    table = rng.integers(0, 4, (400, 6)).astype(np.uint8)
    gradient, hessian = rng.normal(size=400) + (table[:, 2] > 1), np.ones(400)
    row, term = np.nonzero(table)
    terms, cuts, leaves = boosting.grow(row, term, table[row, term], gradient, hessian, 1, 0.1)
    gain = lambda m: gradient[m].sum() ** 2 / (m.sum() + boosting.PENALTY)
    best = max((gain(table[:, t] > c) + gain(table[:, t] <= c), t, c) for t in range(6) for c in range(4)
               if 20 <= (table[:, t] > c).sum() <= 380)
    assert (terms[0], cuts[0]) == best[1:]
    above = table[:, best[1]] > best[2]
    step = lambda m: -0.1 * gradient[m].sum() / (m.sum() + boosting.PENALTY)
    assert np.allclose(leaves, [step(~above), step(above)])
    forest = boosting.Forest(1, [0.0], [(np.array([0]), terms[None], cuts[None], leaves[None])])
    assert np.allclose(forest.raw(400, row, term, table[row, term])[:, 0], np.where(above, leaves[1], leaves[0]))


def test_boosting_reads_all_rows_and_terms(spark):
    """The trees of a pass are those that all rows give, each on its share of the terms, and the shares are all terms."""
    rng = np.random.default_rng(7)
    letters = [chr(0x4E00 + i) for i in range(40)]
    rows = []
    for key in range(5000):
        kind = int(rng.integers(0, 3))
        own = rng.choice(40, size=int(rng.integers(3, 15)), p=np.roll(np.linspace(1, 9, 40), 13 * kind) / 200)
        rows.append((key, "".join(letters[i] for i in own), kind, 1.0 + 4.0 * (kind == 0)))
    frame = spark.createDataFrame(rows, "key long, text string, label int, weight double")
    terms = grams.Terms(letters, [1.0] * 40, 1, 1)
    drawn = frame.select(F.xxhash64("key").alias("draw"), "text", "label", "weight")
    few, many = (boosting.blocks(drawn.repartition(n), terms) for n in (1, 9))
    assert few.agg(F.sum("rows")).first()[0] == many.agg(F.sum("rows")).first()[0] == 5000
    forest, other = (boosting.fit(t, 3, 8, 2, 0.1, 40) for t in (few, many))
    row, term, bin_ = boosting.entries([r[1] for r in rows], terms)
    label, weight = (np.array([r[i] for r in rows]) for i in (2, 3))
    share = np.bincount(label, weight) / weight.sum()
    assert np.allclose(forest.base, np.log(share), atol=1e-6)
    gradient, hessian = boosting.gradients(np.tile(np.array(forest.base), (5000, 1)), label, weight)
    ((classes, found, cuts, leaves),) = forest.passes
    looked = set()
    for tree, (own, of) in enumerate(zip(classes.tolist(), (boosting.scrambled(np.arange(40), 0) * 8).astype(int)[None].repeat(24, 0))):
        mine = of[term] == tree // 3
        looked |= set(term[mine].tolist())
        want = boosting.grow(row[mine], term[mine], bin_[mine], gradient[:, own], hessian[:, own], 2, 0.1)
        assert own == tree % 3 and (found[tree] == want[0]).all() and (cuts[tree] == want[1]).all() and np.allclose(leaves[tree], want[2], atol=1e-5)
    assert looked == set(range(40)) and (cuts < boosting.NO_CUT).sum() > 24
    assert all((x == y).all() for x, y in zip(forest.passes[0], other.passes[0]))


def test_open_labels(spark, corpus):
    """Seven text labels, trained, saved, loaded and named; rows without a label are left out."""
    kinds = ["正常", "刷单", "中奖", "校园贷", "杀猪盘", "退款", "冒充", None]
    rows = [(i, [float(i % 8 == k) + 0.01 * (i % 3) for k in range(8)], kinds[i % 8]) for i in range(400)]
    frame = spark.createDataFrame(rows, "msg_key long, v array<double>, label string")
    path = new_path(spark, "bundle")
    members.fit_semantic(frame, "v", embedded=True, key="msg_key", label="label", normal="正常").save(path)
    again = members.Member.load(spark, path)
    assert again.names == kinds[1:7]
    told = again.predict(frame.where("label IS NOT NULL")).select("label", "predicted_label", again.type_name(F.lit(99)).alias("far")).distinct()
    assert sorted(map(tuple, told.collect())) == sorted((k, k, "未知诈骗") for k in kinds[:7])
    scored = members.score_members(frame.where("label = '刷单'"), {"open": again}).first()["scores"][0]
    assert scored["type"] == "刷单" and scored["prob"] > 0.85


def test_open_labels_of_boosted_trees(spark, corpus):
    words = {0: "正常", 1: "公检法", 2: "贷款", 3: "客服", 4: "领导"}
    named = corpus.withColumn("label", F.get(F.array(*[F.lit(w) for w in words.values()]), F.col("class_id"))).drop("class_id")
    member = members.fit_boosted(named.where("split = 'train'"), "msg_key", "content", label="label", normal="正常")
    path = new_path(spark, "bundle")
    member.save(path)
    judged = members.Member.load(spark, path).predict(named.where("split = 'test'"))
    assert judged.select(F.avg((F.col("label") == F.col("predicted_label")).cast("int"))).first()[0] > 0.8


def test_vectors_do_not_depend_on_partitions(spark, corpus):
    one, many = (vectors.fit(corpus.repartition(n), "content", 16) for n in (1, 9))
    assert one == many and len(one) == corpus.select(F.explode(F.split("content", "")).alias("c")).where("c <> ''").distinct().count()
    assert vectors.fit(corpus.where("false"), "content", 16) == {}
    rows = spark.createDataFrame([(None,), ("",), ("zzz",), ("天天",)], "t string")
    got = [r[0] for r in rows.select(vectors.averager(one, 16)(F.col("t"))).collect()]
    assert got[:3] == [[0.0] * 16] * 3 and np.allclose(got[3], one["天"])


def test_cooccurrence_by_hand(spark):
    rows = spark.createDataFrame([("aba",), ("",), (None,), ("b",)], "t string")
    got = {(r["pair"] >> 21, r["pair"] & (2**21 - 1)): r["n"] for r in vectors.cooccurrence(rows, "t", 2).collect()}
    a, b = ord("a") + 1, ord("b") + 1
    assert got == {(a, 0): 2, (b, 0): 2, (a, b): 2, (a, a): 1}


def test_failing_rows_stand_alone(spark):
    def loader():
        def judge(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no way\nmore")
            return [(0.9, t) for t in texts]

        return judge

    frame = spark.createDataFrame([(i, "bad" if i % 50 == 7 else f"t{i}") for i in range(300)], "k int, t string").coalesce(1)
    got = {r["k"]: tuple(r["scored"]) for r in members.score_guarded(frame, F.col("t"), loader, batch=64).collect()}
    assert got == {i: (None, None, "RuntimeError: no way") if i % 50 == 7 else (0.9, f"t{i}", None) for i in range(300)}

    def broken():
        raise OSError("gone")

    assert {tuple(r["scored"]) for r in members.score_guarded(frame, F.col("t"), broken).collect()} == {(None, None, "OSError: gone")}
    short = lambda: lambda texts: [(1.0, "x")] * (len(texts) - 1)
    assert "results for" in members.score_guarded(frame.limit(3), F.col("t"), short).first()["scored"]["error"]


def test_members_of_all_kinds_vote(spark, corpus):
    fitted = members.fit_presence(corpus.filter("split = 'train'"), "content", buckets=1 << 10, iterations=5)
    answers = spark.createDataFrame([(1, "assistant 贷款诈骗"), (1, "assistant 正常"), (2, "正常")], "msg_key long, answer string")
    voters = {"presence": fitted, "answers": members.AnswerMember("answers", answers, "msg_key"),
              "called": members.CalledMember("called", "content", lambda: lambda texts: [(float(len(t) > 1), "长") for t in texts]), "lost": "gone"}
    rows = {r["msg_key"]: r["scores"] for r in members.score_members(corpus, voters).collect()}
    assert len(rows) == 300 and all(len(s) == 4 for s in rows.values())
    assert rows[1][1]["type"] == "正常"  # the first answer in order of text
    assert rows[2][1]["prob"] == 0.0 and rows[3][1]["prob"] is None and rows[3][3]["error"] == "gone"
    chosen = members.score_members(corpus, voters, ["called"]).first()["scores"]
    assert [s["model"] for s in chosen] == ["called"]


def test_presence_and_bundle(spark, corpus):
    member = members.fit_presence(corpus.filter("split = 'train'"), "content", buckets=1 << 12)
    floors(member, corpus)
    path = new_path(spark, "bundle")
    member.save(path)
    again = members.Member.load(spark, path)
    assert again.params == member.params and again.name == "presence"
    scores = lambda m: {r["msg_key"]: (r["prob"], r["stage2"]) for r in m.score(corpus).collect()}
    assert scores(again) == scores(member)


def test_semantic(spark, corpus):
    """Mean character vectors separate the classes better than chance."""
    member = members.fit_semantic(corpus.filter("split = 'train'"), "content", size=24)
    judged = member.score(corpus.filter("split = 'test'"))
    normal, scam = (judged.filter(c).agg(F.avg("prob")).first()[0] for c in ("class_id = 0", "class_id > 0"))
    assert scam > normal


def test_batch_model_is_loaded_per_worker(spark):
    def loader():
        weights = np.array([1.0, -1.0])
        return lambda pair: pair @ weights

    frame = spark.createDataFrame([([1.0, 2.0],), ([5.0, 3.0],)], "v array<double>")
    out = members.score_batch(frame, [F.col("v")], loader, T.DoubleType(), shapes=[[2]])
    assert [r["prob"] for r in out.collect()] == [-1.0, 2.0]


def test_a_member_that_does_not_load_is_left_out(spark, corpus):
    fitted = members.fit_presence(corpus.filter("split = 'train'"), "content", buckets=1 << 10, iterations=5)
    path = new_path(spark, "bundle")
    fitted.save(path)
    loaded = members.load_members(spark, {"lost": path + "-none", "presence": path})
    blank = corpus.select("msg_key", F.when(F.col("msg_key") > 0, F.col("content")).alias("content"))
    detected = ensemble.detect(members.score_members(blank, loaded), 2)
    details = [list(r["detection"]["details"]) for r in detected.collect()]
    assert len(details) == 300 and all(d == ["presence"] for d in details)
    errors = detected.select(F.col("scores")[0]["error"].alias("e")).distinct().collect()
    assert len(errors) == 1 and errors[0]["e"]


def test_presence_as_the_library_fits(spark):
    """The compact fit takes the steps of Spark ML on the same hashed patterns; Spark's hash is the one used."""
    numbers = [0, 1, -5, 2**40 + 17, 2**62]
    hashed = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "x long").select(F.hash("x")).collect()]
    assert linear.murmur(np.array(numbers)).tolist() == hashed
    rng, buckets = np.random.default_rng(1), 1 << 17
    rows = []
    for key in range(400):
        number, lean = int(rng.integers(0, 5)), int(rng.integers(0, 5))
        letters = rng.choice(list("abcdef"), size=int(rng.integers(0, 12)), p=np.roll([0.4, 0.2, 0.1, 0.1, 0.1, 0.1], number if key % 3 else lean))
        rows.append((key, "".join(letters), number, 5.0 if number == 0 else 1.0))
    frame = spark.createDataFrame(rows, "k long, text string, class_id int, weight double").repartition(3)
    stages = linear.fit(linear.blocks(frame, 2, 4, buckets), 4, buckets, 5)
    ready = HashingTF(inputCol="g", outputCol="features", numFeatures=buckets, binary=True).transform(
        frame.withColumn("g", grams.patterns(2, 4)(F.col("text")))).withColumns({"one": F.col("class_id") > 0, "two": F.col("class_id") - 1.0})
    one = LogisticRegression(labelCol="one", weightCol="weight", maxIter=5).fit(ready.withColumn("one", F.col("one").cast("double")))
    two = LogisticRegression(labelCol="two", family="multinomial", maxIter=5).fit(ready.where("class_id > 0"))
    assert np.allclose(one.coefficients.toArray(), stages[0].weights[0], atol=1e-4) and np.isclose(one.intercept, stages[0].offsets[0], atol=1e-4)
    theirs, own = two.coefficientMatrix.toArray(), stages[1].weights
    assert np.allclose(theirs - theirs.mean(axis=0), own - own.mean(axis=0), atol=1e-4)


def test_presence_holds_texts_in_blocks(spark, monkeypatch):
    """Many long texts leave a task in blocks of bounded size, two bytes a bucket, every text in one of them."""
    frame = spark.createDataFrame([(chr(65 + i % 26) * 3 + str(i) * (400 if i % 9 else 1), i % 5, 1.0) for i in range(3000)], "text string, class_id int, weight double").coalesce(1)
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 2000)
    monkeypatch.setattr(linear, "CHUNK", 1000)
    told = linear.blocks(frame, 2, 4, 1 << 18).collect()
    sizes = [len(r["place"]) // 2 for r in told]
    assert sum(len(r["label"]) // 4 for r in told) == 3000 and max(sizes) < 2100 and len(told) > 10
    assert sum(np.frombuffer(r["size"], np.int32).sum() for r in told) == sum(sizes)


def test_presence_of_nothing(spark, corpus):
    none = members.fit_presence(corpus.where("false"), "content", buckets=1 << 10, iterations=3)
    normal = members.fit_presence(corpus.where("class_id = 0"), "content", buckets=1 << 10, iterations=3)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "天" * 5000)], "msg_key long, content string")
    assert [0 <= r["prob"] <= 1 for r in none.score(odd).collect()] == [True] * 3
    assert all(r["prob"] < 0.5 for r in normal.score(odd).collect())
