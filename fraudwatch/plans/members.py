"""Ensemble members: trained with Spark, called in, or read from a table of answers.

Every fitted member has a binary stage 1 (normal or scam, errors on normal messages
cost more) and a stage 2 that names the scam class.  They differ in features: TF-IDF
with boosted trees, presence of local patterns, and mean vectors.  The names of the
scam classes are part of a member and saved with it: the four known ones, or whatever
labels its training rows carry.
"""

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fraudwatch import fixed
from fraudwatch.functions import grams, labels, text
from fraudwatch.functions.scores import score
from fraudwatch.operators.cleaning import fraud_only, stage_labels, weighted
from fraudwatch.plans import boosting, linear, vectors
from fraudwatch.plans.cascade import cascade, scam_probability
from fraudwatch.plans.features import TermModel, index_labels, tfidf_fit
from fraudwatch.plans.replies import parse_generated
from fraudwatch.session import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCRATCH = ["raw1", "probability1", "prediction1", "raw2", "prediction2", "grams", "features", "tokens"]
#: Distinct labels that a member tells apart at most.
MAX_LABELS = 1000


def _columns(stage: int) -> dict:
    both = {"featuresCol": "features", "predictionCol": f"prediction{stage}"}
    return both | {"rawPredictionCol": f"raw{stage}"}


def fit_stage1(blocks: DataFrame, terms: int, rounds: int = 300, depth: int = 5, rate: float = 0.1) -> boosting.Forest:
    """Boosted trees that tell scam from normal; the rows of ``boosting.blocks`` carry their cost weights."""
    return boosting.fit(blocks, 2, rounds, depth, rate, terms)


def fit_stage2(blocks: DataFrame, terms: int, classes: int, rounds: int = 150, depth: int = 5, rate: float = 0.1) -> boosting.Forest:
    """Boosted trees that name the scam class: each round grows one per class, on scam rows only."""
    return boosting.fit(blocks, max(2, classes), rounds, depth, rate, terms)


def fit_linear1(df: DataFrame, iterations: int = 50):
    model = LogisticRegression(
        labelCol="stage1_label", weightCol="cost_weight", maxIter=iterations, probabilityCol="probability1",
        **_columns(1),
    )
    return model.fit(df)


def fit_linear2(df: DataFrame, iterations: int = 50):
    model = LogisticRegression(
        labelCol="stage2_label", family="multinomial", maxIter=iterations, probabilityCol="probability2",
        **_columns(2),
    )
    return model.fit(df)


def label_classes(train: DataFrame, key: str, label: str, normal: str) -> tuple[DataFrame, list[str]]:
    """Rows with a label, with ``class_id``: 0 is the normal label, the others count up by first appearance; and their names."""
    known = train.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("string"))
    dictionary = index_labels(known.where(F.col(label) != normal), key, label)
    names = [r[label] for r in dictionary.orderBy("label_id").limit(MAX_LABELS + 1).collect()]
    if len(names) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    numbered = F.broadcast(dictionary.withColumnRenamed(label, "_label"))
    met = known.drop("class_id").join(numbered, F.col(label) == F.col("_label"), "left")
    return met.withColumn("class_id", F.coalesce(F.col("label_id") + 1, F.lit(0)).cast("int")).drop("_label", "label_id"), names


class TwoStages:
    """What fitted members share: class names, the two-stage rule, and their bundle's head."""

    name: str
    params: dict

    @property
    def names(self) -> list[str]:
        return self.params.get("labels", fixed.SCAM_TYPES)

    def type_name(self, stage2: Column) -> Column:
        """Name of a stage-2 class; one that the member does not know has the unknown type."""
        return F.coalesce(F.get(F.array(*[F.lit(n) for n in self.names]), stage2), F.lit(fixed.UNKNOWN_TYPE))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prob``, ``predicted`` class and its name by the two-stage rule."""
        chosen = cascade(F.col("prob"), F.col("stage2"), self.params["threshold"])
        named = F.when(F.col("predicted") == 0, fixed.NORMAL).otherwise(self.type_name(F.col("predicted") - 1))
        return self.score(df).withColumn("predicted", chosen).withColumn("predicted_label", named)

    def results(self, messages: DataFrame, order: int) -> tuple[DataFrame, Column, Column, Column]:
        """The messages with this member's columns, and its probability, type and error among them."""
        prob, stage = f"_prob{order}", f"_stage{order}"
        told = self.score(messages).withColumnsRenamed({"prob": prob, "stage2": stage})
        return told, F.col(prob), self.type_name(F.col(stage)), F.lit(None).cast("string")

    def _save_head(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        row = [(self.name, json.dumps(self.params, ensure_ascii=False))]
        spark.createDataFrame(row, "name string, params string").write.mode("overwrite").json(f"{path}/params")


@dataclass
class Member(TwoStages):
    """A fitted two-stage member: row-local features, then both stages."""

    name: str
    features: PipelineModel
    stage1: PipelineModel
    stage2: PipelineModel
    params: dict = field(default_factory=dict)
    vectors: dict = field(default_factory=dict)

    def prepare(self, df: DataFrame) -> DataFrame:
        return _prepare(df, self.params, self.vectors)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prob`` and ``stage2``; both stages run for every message."""
        ready = self.features.transform(self.prepare(df))
        scored = self.stage2.transform(self.stage1.transform(ready))
        named = scored.withColumns(
            {"prob": scam_probability(F.col("probability1")), "stage2": F.col("prediction2").cast("int")}
        )
        return named.drop(*SCRATCH, "probability1", "probability2")

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        self.stage1.write().overwrite().save(f"{path}/stage1")
        self.stage2.write().overwrite().save(f"{path}/stage2")
        if self.vectors:
            spark = SparkSession.getActiveSession()
            told = spark.createDataFrame(list(self.vectors.items()), "ch string, vector array<double>")
            told.write.mode("overwrite").parquet(f"{path}/vectors")
        self._save_head(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Member | BoostedMember | PresenceMember":
        row = spark.read.schema("name string, params string").json(f"{path}/params").first()
        params = json.loads(row["params"])
        if params["kind"] == "boosted":
            return BoostedMember.read(spark, path, row["name"], params)
        if params["kind"] == "patterns":
            return PresenceMember.read(spark, path, row["name"], params)
        models = [PipelineModel.load(f"{path}/{part}") for part in ("features", "stage1", "stage2")]
        told = spark.read.parquet(f"{path}/vectors").collect() if params["kind"] == "characters" else []
        return Member(row["name"], *models, params, {r["ch"]: r["vector"] for r in told})


@dataclass
class BoostedMember(TwoStages):
    """TF-IDF terms and two forests: one score for scam or normal, one per scam class."""

    name: str
    terms: TermModel
    stage1: boosting.Forest
    stage2: boosting.Forest
    params: dict

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prob`` and ``stage2``; both stages run for every message."""
        judge = boosting.scorer(self.terms.packed(), self.stage1, self.stage2)
        content = text.squeeze(F.coalesce(F.col(self.params["column"]), F.lit("")))
        # A generator takes the pair apart, so that the forests run once per message.
        return df.select("*", F.inline(F.array(judge(content))))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        told = list(zip(range(len(self.terms.terms)), self.terms.terms, self.terms.idf))
        spark.createDataFrame(told, "place int, term string, idf double").write.mode("overwrite").parquet(f"{path}/terms")
        for stage, forest in (("stage1", self.stage1), ("stage2", self.stage2)):
            spark.createDataFrame(forest.rows(), boosting.Forest.ROWS).write.mode("overwrite").parquet(f"{path}/{stage}")
        self._save_head(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, name: str, params: dict) -> "BoostedMember":
        told = spark.read.parquet(f"{path}/terms").orderBy("place").collect()
        terms = TermModel([r["term"] for r in told], [r["idf"] for r in told], params["shortest"], params["longest"])
        forests = [
            boosting.Forest.of(params["depth"], base, spark.read.parquet(f"{path}/{stage}").collect())
            for stage, base in zip(("stage1", "stage2"), params["bases"])
        ]
        return cls(name, terms, *forests, params)


@dataclass
class PresenceMember(TwoStages):
    """Which hashed character patterns occur in a text, with a linear model per stage."""

    name: str
    stage1: linear.Linear
    stage2: linear.Linear
    params: dict

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prob`` and ``stage2``; both stages run for every message."""
        judge = linear.scorer(self.params["shortest"], self.params["longest"], self.stage1, self.stage2)
        content = text.squeeze(F.coalesce(F.col(self.params["column"]), F.lit("")))
        # A generator takes the pair apart, so that a text's patterns are cut once.
        return df.select("*", F.inline(F.array(judge(content))))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        told = [
            (stage, place, float(offset), weights.tobytes())
            for stage, model in enumerate((self.stage1, self.stage2)) for place, (weights, offset) in enumerate(zip(model.weights, model.offsets))
        ]
        spark.createDataFrame(told, "stage int, place int, offset double, weights binary").write.mode("overwrite").parquet(f"{path}/weights")
        self._save_head(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, name: str, params: dict) -> "PresenceMember":
        told = spark.read.parquet(f"{path}/weights").orderBy("stage", "place").collect()  # a row per class
        stages = [[r for r in told if r["stage"] == n] for n in (0, 1)]
        models = [linear.Linear(np.stack([np.frombuffer(r["weights"]) for r in s]), np.array([r["offset"] for r in s])) for s in stages]
        return cls(name, *models, params)


@dataclass
class CalledMember:
    """A caller's model in the vote.  Rows on which it raises get its error, all others their scores.

    ``loader`` runs once per Python worker and returns a function of a list of inputs
    that gives a probability and a type for each.
    """

    name: str
    column: str
    loader: Callable
    batch: int = 128

    def results(self, messages: DataFrame, order: int) -> tuple[DataFrame, Column, Column, Column]:
        told = score_guarded(messages, F.col(self.column), self.loader, f"_called{order}", self.batch)
        called = F.col(f"_called{order}")
        return told, called["prob"], called["type"], called["error"]


@dataclass
class AnswerMember:
    """Generated labels in the vote: a table of (key, answer), one answer per key, joined to the messages.

    A message without an answer has no score; of several answers to a key the first in
    order of text counts.
    """

    name: str
    answers: DataFrame
    key: str
    answer: str = "answer"

    def results(self, messages: DataFrame, order: int) -> tuple[DataFrame, Column, Column, Column]:
        given = self.answers.groupBy(F.col(self.key).alias("_key")).agg(F.min(self.answer).alias(f"_answer{order}"))
        told = messages.join(given, F.col(self.key) == F.col("_key"), "left").drop("_key")
        judged = parse_generated(F.col(f"_answer{order}"))
        return told, judged["prob"], judged["type"], F.lit(None).cast("string")


def _prepare(df: DataFrame, params: dict, known: dict | None = None) -> DataFrame:
    """Turn the input column into what the feature stages read."""
    source = F.col(params["column"])
    if params["kind"] == "vector":
        return df.withColumn("features", array_to_vector(source.cast("array<double>")))
    source = F.coalesce(source, F.lit(""))
    if params["kind"] == "characters":
        return df.withColumn("features", array_to_vector(vectors.averager(known, params["size"])(source)))
    return df.withColumn("grams", grams.patterns(params["shortest"], params["longest"])(text.squeeze(source)))


def _labelled(train: DataFrame, key: str | None, label: str | None, normal: str) -> tuple[DataFrame, dict]:
    """Training rows with ``class_id``, and the names of their classes for the bundle."""
    if label is None:
        return train, {}
    named, names = label_classes(train, key, label, normal)
    return named, {"labels": names}


def _fit(name, train, features, params, first, second, known=None) -> Member:
    """Compute the features once, then fit both stages on them."""
    shared_folder(train.sparkSession)
    labelled = stage_labels(weighted(train)).select(
        params["column"], "class_id", "stage1_label", "stage2_label", "cost_weight"
    )
    ready = features.transform(_prepare(labelled, params, known))
    ready = ready.select("features", "class_id", "stage1_label", "stage2_label", "cost_weight")
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stage1 = first(ready)
        stage2 = second(fraud_only(ready))
    finally:
        ready.unpersist()
    params = {"threshold": fixed.FRAUD_THRESHOLD} | params
    return Member(name, features, PipelineModel([stage1]), PipelineModel([stage2]), params, known or {})


def fit_boosted(
    train: DataFrame, key: str, column: str, max_terms: int = fixed.MAX_TERMS, rounds1: int = 300,
    rounds2: int = 150, depth: int = 5, rate: float = 0.1, fit_rows: int | None = None,
    label: str | None = None, normal: str = "0",
) -> BoostedMember:
    """Character TF-IDF with boosted trees in both stages.

    Terms are counted over all training rows, and all of them are boosted; only a caller
    that names ``fit_rows`` has each stage boost that many of its rows at most.  With
    ``label`` the classes are the labels found there, else ``class_id`` and the four
    known scam types.
    """
    train, names = _labelled(train, key, label, normal)
    terms = tfidf_fit(train, key, column, max_terms)
    packed = terms.packed()
    rows = stage_labels(weighted(train))
    one, content = F.lit(1.0), F.col(column)
    first = boosting.blocks(rows.select(*boosting.drawn(F.col(key), F.col("stage1_label"), F.col("cost_weight"), content)), packed, fit_rows)
    second = boosting.blocks(fraud_only(rows).select(*boosting.drawn(F.col(key), F.col("stage2_label"), one, content)), packed, fit_rows)
    kinds = len(names.get("labels", fixed.SCAM_TYPES))
    size = len(packed.numbers)
    stage1 = fit_stage1(first, size, rounds1, depth, rate)
    stage2 = fit_stage2(second, size, kinds, rounds2, depth, rate)
    params = {
        "kind": "boosted", "column": column, "shortest": terms.shortest, "longest": terms.longest, "depth": depth,
        "bases": [stage1.base, stage2.base], "threshold": fixed.FRAUD_THRESHOLD,
    }
    return BoostedMember("boosted", terms, stage1, stage2, params | names)


def fit_presence(
    train: DataFrame, column: str, shortest: int = 2, longest: int = 4, buckets: int = 1 << 18, iterations: int = 50,
    key: str | None = None, label: str | None = None, normal: str = "0",
) -> PresenceMember:
    """Which local character patterns occur, with linear stages fitted over all rows."""
    train, names = _labelled(train, key, label, normal)
    rows = stage_labels(weighted(train)).where(F.col("class_id").isNotNull())
    content = text.squeeze(F.coalesce(F.col(column), F.lit("")))
    rows = rows.select(content.alias("text"), F.col("class_id").cast("int").alias("class_id"), F.col("cost_weight").cast("double").alias("weight"))
    classes = len(names.get("labels", fixed.SCAM_TYPES))
    stage1, stage2 = linear.fit(linear.blocks(rows, shortest, longest, buckets), max(2, classes), buckets, iterations)
    params = {"kind": "patterns", "column": column, "shortest": shortest, "longest": longest, "threshold": fixed.FRAUD_THRESHOLD}
    return PresenceMember("presence", stage1, stage2, params | names)


def fit_semantic(
    train: DataFrame, column: str, embedded: bool = False, size: int = 64, iterations: int = 50,
    key: str | None = None, label: str | None = None, normal: str = "0",
) -> Member:
    """Mean vector per message, with linear stages.

    The vector is either a given embedding column or the mean of character vectors
    learned from the training texts; those do not depend on the cluster.
    """
    train, names = _labelled(train, key, label, normal)
    if embedded:
        params, known = {"kind": "vector", "column": column}, {}
    else:
        params, known = {"kind": "characters", "column": column, "size": size}, vectors.fit(train, column, size)
    return _fit(
        "semantic", train, PipelineModel([]), params | names,
        lambda df: fit_linear1(df, iterations), lambda df: fit_linear2(df, iterations), known,
    )


AnyMember = Member | BoostedMember | PresenceMember | CalledMember | AnswerMember | str


def load_members(spark: SparkSession, paths: dict[str, str]) -> dict[str, AnyMember]:
    """Saved members by name; one that cannot be loaded is represented by its error."""
    loaded = {}
    for name, path in paths.items():
        try:
            loaded[name] = Member.load(spark, path)
        except Exception as error:  # whatever is wrong with one bundle, the others still vote
            loaded[name] = f"{type(error).__name__}: {str(error).splitlines()[0]}"
    return loaded


def score_members(messages: DataFrame, members: dict[str, AnyMember], enabled: list[str] | None = None) -> DataFrame:
    """Add ``scores`` with a place per member, in the given order.

    Both stages run for every message and the type is kept below the threshold.
    All members score the same rows one after the other; only the table of an
    ``AnswerMember`` is joined.  ``enabled`` leaves members out.
    """
    kept, places = messages.columns, []
    chosen = {n: m for n, m in members.items() if enabled is None or n in enabled}
    for order, (name, member) in enumerate(chosen.items()):
        if isinstance(member, str):
            nothing = F.lit(None)
            places.append(score(order, name, nothing, nothing.cast("string"), F.lit(member)))
            continue
        messages, prob, kind, error = member.results(messages, order)
        places.append(score(order, name, prob, kind, error))
    return messages.select(*kept, F.array(*places).alias("scores"))


def score_batch(
    df: DataFrame, inputs: list[Column], loader: Callable, result_type, target: str = "prob",
    batch: int = 128, shapes: list | None = None,
) -> DataFrame:
    """Score with a caller's model; ``loader`` runs once per Python worker."""
    model = predict_batch_udf(loader, return_type=result_type, batch_size=batch, input_tensor_shapes=shapes)
    return df.withColumn(target, model(*inputs))


GUARDED = T.StructType([
    T.StructField("prob", T.DoubleType()), T.StructField("type", T.StringType()), T.StructField("error", T.StringType()),
])


def guarded(model: Callable, inputs: list) -> list[tuple]:
    """(prob, type, error) of every input: a batch that fails is halved until the failing inputs stand alone."""
    if not inputs:
        return []
    try:
        told = [(float(p), None if kind is None else str(kind), None) for p, kind in model(inputs)]
        if len(told) != len(inputs):
            raise ValueError(f"{len(told)} results for {len(inputs)} inputs")
        return told
    except Exception as error:  # the model is a caller's: whatever it raises belongs to its rows
        if len(inputs) == 1:
            return [(None, None, f"{type(error).__name__}: {error}".splitlines()[0])]
    half = len(inputs) // 2
    return guarded(model, inputs[:half]) + guarded(model, inputs[half:])


def score_guarded(df: DataFrame, column: Column, loader: Callable, target: str = "scored", batch: int = 128) -> DataFrame:
    """Add ``target`` with prob, type and error of a caller's model, in batches.

    One message on which the model raises costs about log2(batch) more calls and is the
    only one without a score; a model that cannot be loaded fails on every row.
    """

    def judge(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            model = loader()
        except Exception as error:  # the rows then carry the reason
            reason = f"{type(error).__name__}: {error}".splitlines()[0]
            model = None
        for values in series:
            given = values.tolist()
            told = []
            for start in range(0, len(given), batch):
                part = given[start : start + batch]
                told += guarded(model, part) if model else [(None, None, reason)] * len(part)
            # Object columns keep a missing number missing.
            yield pd.DataFrame({n: pd.Series([t[i] for t in told], dtype=object) for i, n in enumerate(("prob", "type", "error"))})

    return df.withColumn(target, F.pandas_udf(judge, GUARDED)(column))
