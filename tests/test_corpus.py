"""Cleaning, splits and features."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fraudwatch.functions import grams, labels, text
from fraudwatch.operators import cleaning, splits
from fraudwatch.plans import features
from fraudwatch.session import new_path
from tests.conftest import tuples

texts = st.text(alphabet="ab 贷款😀\n　é", max_size=12)


def test_strip_and_blanks(one):
    assert one(text.strip(F.col("t")), t="　  a b\x1c\n") == "a b"
    assert one(text.blank_to(F.col("t"), "无内容"), t=" 　\n") == "无内容"
    assert one(text.blank_to(F.col("t"), "无内容"), t=None) == "无内容"
    assert one(labels.canonical_label(F.col("t")), t="0.0") == "0"
    assert one(labels.canonical_label(F.col("t")), t="10") == "10"
    assert one(text.missing_to_null(F.col("t")), t="NA") is None
    assert one(text.missing_to_null(F.col("t")), t="na") == "na"
    assert one(text.preview(F.col("t"), 2), t="abc") == "ab..."


def test_feedback(spark):
    raw = spark.createDataFrame([("a,b\nc", None), ("", "x"), ("\n", "x"), (None, "x")], "content string, label string")
    good, bad = cleaning.clean_feedback(raw)
    assert tuples(good) == [(" ", "x"), ("a，b c", "正常")]
    assert bad.count() == 2


def test_stage_labels(spark):
    frame = spark.createDataFrame([(c,) for c in range(5)], "class_id int")
    staged = cleaning.weighted(cleaning.stage_labels(frame)).withColumn(
        "again", labels.actual_class(F.col("stage1_label"), F.col("stage2_label"))
    )
    assert tuples(staged) == [(c, int(c > 0), c - 1, 1.0 if c else 5.0, c) for c in range(5)]
    assert cleaning.fraud_only(frame).count() == 4


def ordered(spark, sizes):
    """Group g holds keys that interleave with the other groups' keys."""
    rows = [(g, n * 10 + g) for g, size in enumerate(sizes) for n in range(size)]
    return spark.createDataFrame(rows, "g int, key long").repartition(7)


def counts(df):
    return {(r["g"], r["split"]): r["n"] for r in splits.split_summary(df, "g").collect()}


def test_split_sizes(spark):
    frame = ordered(spark, [10, 15, 9])
    assert counts(splits.split_head(frame, "g", "key")) == {
        (0, "train"): 9, (0, "test"): 1, (1, "train"): 13, (1, "test"): 2, (2, "train"): 8, (2, "test"): 1}
    assert counts(splits.split_tail(frame, "g", "key")) == {
        (0, "train"): 9, (0, "test"): 1, (1, "train"): 14, (1, "test"): 1, (2, "train"): 9}
    assert counts(splits.split_gap(frame, "g", "key")) == {
        (0, "train"): 9, (0, "test"): 1, (1, "train"): 13, (1, "none"): 1, (1, "test"): 1, (2, "train"): 8, (2, "none"): 1}


KEYS = [
    ("long", st.integers(-(2**40), 2**60)), ("double", st.floats(0, 1)), ("string", st.text("abé", max_size=2)), ("long", st.sampled_from([None, 1, 2])),
]


@settings(max_examples=8, deadline=None)
@given(data=st.data())
def test_cut_equals_a_full_sort(spark, data):
    """Keys of any type, repeated and missing ones, and a null group are split as sorting splits them."""
    kind, values = data.draw(st.sampled_from(KEYS))
    keys = data.draw(st.lists(values, min_size=1, max_size=40))
    groups = data.draw(st.lists(st.sampled_from([None, 0, 1]), min_size=len(keys), max_size=len(keys)))
    rows = [(g, k, i) for i, (g, k) in enumerate(zip(groups, keys))]
    frame = spark.createDataFrame(rows, f"g int, key {kind}, tie long").repartition(3)
    train = {r["tie"] for r in splits.split_head(frame, "g", "key", tie="tie").filter("split = 'train'").collect()}
    want = set()
    for g in set(groups):
        place = lambda k: (k is not None, (k.encode() if isinstance(k, str) else k) if k is not None else 0)
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (place(r[1]), r[2]))
        want |= {r[2] for r in own[: int(len(own) * 0.9)]}
    assert train == want


def test_equal_rows_across_the_cut(spark):
    """Rows that nothing tells apart are still divided in the right numbers."""
    same = spark.createDataFrame([(0, 5)] * 20 + [(None, None)] * 20, "g int, key int").repartition(4)
    got = counts(splits.split_tail(same, "g", "key"))
    assert got == {(0, "train"): 18, (0, "test"): 2, (None, "train"): 18, (None, "test"): 2}


def test_seeded_splits(spark):
    frame = ordered(spark, [50, 31, 19])
    by_hash = splits.split_shuffled(frame, "g", "key")
    again = splits.split_shuffled(frame.repartition(3), "g", "key")
    assert tuples(by_hash.select("key", "split")) == tuples(again.select("key", "split"))
    other = splits.split_shuffled(frame, "g", "key", seed=7)
    assert tuples(by_hash.select("key", "split")) != tuples(other.select("key", "split"))
    assert counts(by_hash)[0, "train"] == 45 and counts(by_hash)[1, "train"] == 27


def test_stratified_sizes(spark):
    sizes = [50, 31, 20]
    got = counts(splits.split_stratified(ordered(spark, sizes), "g", "key"))
    assert sum(n for (_, part), n in got.items() if part == "test") == math.ceil(101 * 0.2)
    for g, size in enumerate(sizes):
        assert abs(got[g, "test"] - 0.2 * size) <= 1


def test_splits_do_not_move_the_texts(spark):
    """Whatever the split, no exchange lies above the scan of the texts."""
    rows = spark.range(500).selectExpr("id AS key", "int(id % 3) AS g", "concat('text ', id) AS content")
    path = new_path(spark, "texts")
    rows.write.parquet(path)
    frame = spark.read.parquet(path)
    for split in (splits.split_head, splits.split_tail, splits.split_gap, splits.split_stratified, splits.split_shuffled):
        out = split(frame, "g", "key")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 1 and "SortMergeJoin" not in plan and "content" in plan
        assert not any("Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line for line in plan.splitlines())
        assert out.count() == 500


def test_hot_group(spark):
    """A third of the rows in one group, with clustered keys."""
    hot = spark.range(40_000).selectExpr("0 AS g", "id AS key")
    cold = spark.range(80_000).selectExpr("1 + id % 50 AS g", "(id << 33) AS key")
    frame = hot.unionByName(cold.withColumn("g", F.col("g").cast("int")))
    out = splits.split_head(frame, "g", "key")
    bad = out.groupBy("g").agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("split") == "train", F.col("key"))).alias("last"),
        F.min(F.when(F.col("split") == "test", F.col("key"))).alias("first"),
    ).filter("train <> floor(n * 0.9D) OR last >= first")
    assert bad.count() == 0


def python_grams(value, low, high):
    import re

    squeezed = re.sub(r"\s\s+", " ", value.lower())
    return Counter(squeezed[i : i + n] for n in range(low, high + 1) for i in range(len(squeezed) - n + 1))


@settings(max_examples=15, deadline=None)
@given(values=st.lists(texts, min_size=1, max_size=8))
def test_grams_count_like_a_loop(spark, values):
    frame = spark.createDataFrame(list(enumerate(values)), "key long, content string")
    got = {}
    for r in features.gram_rows(frame, "key", "content", 1, 3).collect():
        got.setdefault(r["key"], Counter())[r["gram"]] = r["tf"]
    for key, value in enumerate(values):
        assert got.get(key, Counter()) == python_grams(value, 1, 3)


@given(value=texts, piece=st.integers(1, 5), sizes=st.sampled_from([(1, 3), (2, 4), (1, 1), (3, 3)]))
def test_counting_in_pieces_changes_nothing(value, piece, sizes):
    """Pieces give the counts of the whole text, and numbers sort and spell as the grams do."""
    numbers, counts = grams.histogram(value, *sizes, piece)
    whole = grams.histogram(value, *sizes)
    assert numbers.tolist() == whole[0].tolist() and counts.tolist() == whole[1].tolist()
    assert sum(counts) == sum(max(0, len(value) - n + 1) for n in range(sizes[0], sizes[1] + 1))
    if sizes[1] <= 3:
        told = grams.texts_of(numbers).to_pylist()
        assert told == sorted(told) and [grams.number_of(g) for g in told] == numbers.tolist()


def test_numbers_become_text(spark):
    told = ["a", "ab", "abc", "\0", "\0a", "贷款😀", "\U0010ffff" * 3]
    frame = spark.createDataFrame([(grams.number_of(g), g) for g in told], "number bigint, gram string")
    assert all(r[0] == r[1] for r in frame.select(grams.text_of(F.col("number")), "gram").collect())


def test_grams_of_missing_and_long_texts(spark):
    long = "ab cd" * 200_000
    frame = spark.createDataFrame([("x", None), ("y", ""), ("z", long), ("z", long)], "key string, content string")
    got = Counter((r["key"], r["gram"], r["tf"]) for r in features.gram_rows(frame, "key", "content").collect())
    assert got == Counter({("z", g, n): 2 for g, n in python_grams(long, 1, 3).items()})
    stats = {r["gram"]: (r["tf"], r["df"]) for r in features.term_statistics(frame, "key", "content").collect()}
    assert stats == {g: (2 * n, 2) for g, n in python_grams(long, 1, 3).items()}
    with pytest.raises(ValueError):
        features.gram_rows(frame, "key", "content", 2, 4)


def test_grams_of_a_short_text(one):
    assert one(text.char_ngrams(F.col("t")), t="ab") == ["a", "b", "ab"]
    assert one(text.char_ngrams(F.col("t"), 2, 4), t="abc") == ["ab", "bc", "abc"]


def test_tfidf_by_hand(spark):
    train = spark.createDataFrame([(0, "a"), (1, "ab")], "key long, content string")
    model = features.tfidf_fit(train, "key", "content", shortest=1, longest=1)
    assert dict(zip(model.terms, (round(x, 6) for x in model.idf))) == {"a": 1.0, "b": 1.405465}
    weights = {(r["key"], r["gram"]): round(r["weight"], 6) for r in features.tfidf_long(model, train, "key", "content").collect()}
    assert weights == {(0, "a"): 1.0, (1, "a"): 0.579739, (1, "b"): 0.814802}
    vectors = features.tfidf_vectors(model, train, "content").collect()
    assert [round(x, 6) for x in vectors[1]["features"].toArray()] == [0.579739, 0.814802]


def test_term_cap_breaks_ties_by_text(spark):
    frame = spark.createDataFrame([(0, "cbaa")], "key long, content string")
    top = features.top_terms(frame, "key", "content", 2, shortest=1, longest=1)
    assert [r["gram"] for r in top.collect()] == ["a", "b"]


def test_vocabulary_and_codes(spark):
    frame = spark.createDataFrame([(1, "ac"), (0, "ba")], "key long, content string")
    vocab = features.build_vocab(frame, "key", "content")
    assert dict(tuples(vocab)) == {"b": 2, "a": 3, "c": 4}
    codes = features.Vocabulary.of(vocab)
    asked = spark.createDataFrame([(0, "az"), (1, ""), (2, "cabab"), (3, None), (4, "😀b")], "key long, content string")
    out = {r["key"]: (r["input_ids"], r["attention_mask"]) for r in features.encode_masked(asked, codes, "content", 4).collect()}
    assert out == {
        0: ([3, 1, 0, 0], [1, 1, 0, 0]), 1: ([0] * 4, [0] * 4), 2: ([4, 3, 2, 3], [1] * 4), 3: ([0] * 4, [0] * 4),
        4: ([1, 2, 0, 0], [1, 1, 0, 0])}


@settings(max_examples=10, deadline=None)
@given(values=st.lists(texts, min_size=1, max_size=5), length=st.integers(1, 9))
def test_codes_have_one_length(spark, values, length):
    frame = spark.createDataFrame(list(enumerate(values)), "key long, content string")
    codes = features.Vocabulary.of(features.build_vocab(frame, "key", "content"))
    back = {number: ch for ch, number in codes.ids.items()}
    for row in features.encode(frame, codes, "content", length).collect():
        assert len(row["encoded"]) == length
        assert "".join(back[i] for i in row["encoded"] if i > 1) == row["content"][:length]


def test_chat(spark):
    frame = spark.createDataFrame([(" 你好 ", None), ("", "贷款诈骗")], "content string, label string")
    rows = features.to_chat(frame).collect()
    assert [[tuple(m) for m in r["messages"]] for r in rows] == [
        [("user", "你好"), ("assistant", "无标签")], [("user", "无内容"), ("assistant", "贷款诈骗")]]
    flat = features.to_chat(frame, with_answer=False).select(features.flatten_chat(F.col("messages"))).collect()
    assert flat[0][0] == "user\n你好"


def test_label_dictionary(spark):
    frame = spark.createDataFrame([(3, "x"), (1, "y"), (2, "x")], "key long, label string")
    dictionary = features.index_labels(frame, "key", "label")
    assert tuples(dictionary) == [("x", 1), ("y", 0)]
    asked = spark.createDataFrame([(0,), (1,), (9,)], "id int")
    named = features.name_labels(asked, dictionary, "label", "id")
    assert tuples(named) == [(0, "y"), (1, "x"), (9, "未知诈骗")]
