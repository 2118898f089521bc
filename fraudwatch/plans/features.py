"""Character features, vocabularies, encodings and chat examples."""

import json
import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window, functions as F

from fraudwatch import fixed
from fraudwatch.functions import grams, text
from fraudwatch.operators.ordering import global_rank

CODE_POINTS = 0x110000


def _spellable(longest: int) -> None:
    if longest > grams.PACKED:
        raise ValueError(f"grams that are told as text have at most {grams.PACKED} characters")


def gram_rows(df: DataFrame, key: str, column: str, shortest: int = 1, longest: int = 3) -> DataFrame:
    """``(key, gram, tf)``, counted inside each row; a missing or empty text has none."""
    _spellable(longest)
    rows = grams.keyed(df, key, text.squeeze(F.col(column)))
    told = rows.mapInArrow(lambda b: grams.spelled(b, shortest, longest), grams.out_schema(df, key, "gram string, tf int"))
    return told.withColumnRenamed("key", key)


def _statistics(df: DataFrame, key: str, column: str, shortest: int, longest: int) -> DataFrame:
    """``(number, tf, df)`` of every gram: sums of a batch leave its task, numbers are shuffled."""
    _spellable(longest)
    rows = grams.keyed(df, key, text.squeeze(F.col(column)))
    partial = rows.mapInArrow(lambda b: grams.sums(b, shortest, longest), "number bigint, tf bigint, df bigint")
    return partial.groupBy("number").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def term_statistics(df: DataFrame, key: str, column: str, shortest: int = 1, longest: int = 3) -> DataFrame:
    """Corpus frequency and document frequency of every gram, in one aggregation."""
    return _statistics(df, key, column, shortest, longest).select(grams.text_of(F.col("number")).alias("gram"), "tf", "df")


def top_terms(
    df: DataFrame, key: str, column: str, max_terms: int = fixed.MAX_TERMS, shortest: int = 1, longest: int = 3
) -> DataFrame:
    """The most frequent grams; numbers order ties as their texts would."""
    most = _statistics(df, key, column, shortest, longest).orderBy(F.desc("tf"), F.asc("number")).limit(max_terms)
    return most.select(grams.text_of(F.col("number")).alias("gram"), "tf", "df")


@dataclass
class TermModel:
    """Terms and weights of a fitted TF-IDF; at most ``max_terms`` entries."""

    terms: list[str]
    idf: list[float]
    shortest: int = 1
    longest: int = 3

    def packed(self) -> grams.Terms:
        return grams.Terms(self.terms, self.idf, self.shortest, self.longest)

    def stages(self, source: str = "grams", target: str = "features") -> PipelineModel:
        return PipelineModel(
            [
                CountVectorizerModel.from_vocabulary(self.terms, inputCol=source, outputCol="tf"),
                ElementwiseProduct(
                    scalingVec=Vectors.dense(self.idf), inputCol="tf", outputCol="weighted"
                ),
                Normalizer(p=2.0, inputCol="weighted", outputCol=target),
            ]
        )

    def with_grams(self, df: DataFrame, column: str, target: str = "grams") -> DataFrame:
        return df.withColumn(target, text.char_ngrams(F.col(column), self.shortest, self.longest))


def tfidf_fit(
    train: DataFrame, key: str, column: str, max_terms: int = fixed.MAX_TERMS, shortest: int = 1, longest: int = 3
) -> TermModel:
    """Smoothed idf ``ln((1+N)/(1+df)) + 1`` over the most frequent terms."""
    rows = train.count()
    terms = top_terms(train, key, column, max_terms, shortest=shortest, longest=longest).collect()
    idf = [math.log((1 + rows) / (1 + t["df"])) + 1 for t in terms]
    return TermModel([t["gram"] for t in terms], idf, shortest, longest)


def tfidf_vectors(model: TermModel, df: DataFrame, column: str, target: str = "features") -> DataFrame:
    """Sparse L2-normalised vectors, computed row by row without a shuffle."""
    ready = model.with_grams(df, column)
    return model.stages(target=target).transform(ready).drop("grams", "tf", "weighted")


def tfidf_long(model: TermModel, df: DataFrame, key: str, column: str) -> DataFrame:
    """The same weights as rows ``(key, gram, weight)``; the norm is taken inside the row, nothing is shuffled."""
    terms = model.packed()
    rows = grams.keyed(df, key, text.squeeze(F.col(column)))
    told = rows.mapInArrow(lambda b: grams.weighed(b, terms), grams.out_schema(df, key, "gram string, weight double"))
    return told.withColumnRenamed("key", key)


def build_vocab(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(ch, id)`` in order of first appearance; ids 0 and 1 are reserved.

    There are at most as many rows as Unicode has code points, which also bounds
    the closing window.
    """
    # Distinct characters keep the order in which they appear, and there are few per text.
    distinct = F.array_distinct(text.characters(F.col(column)))
    places = df.select(key, F.posexplode_outer(distinct).alias("pos", "ch"))
    firsts = places.filter("ch IS NOT NULL").groupBy("ch").agg(F.min(F.struct(key, "pos")).alias("at"))
    order = F.row_number().over(Window.orderBy("at"))
    return firsts.select("ch", (order + fixed.UNK_ID).alias("id"))


class Vocabulary:
    """Character ids as an array indexed by code point: lookup is one array read."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids

    @classmethod
    def of(cls, vocab: DataFrame) -> "Vocabulary":
        rows = vocab.limit(CODE_POINTS + 1).collect()
        if len(rows) > CODE_POINTS:
            raise ValueError("a character vocabulary cannot exceed the code points")
        return cls({row["ch"]: row["id"] for row in rows})

    def table(self) -> Column:
        slots = [None] * (max((ord(ch) for ch in self.ids), default=0) + 1)
        for ch, number in self.ids.items():
            slots[ord(ch)] = number
        return F.from_json(F.lit(json.dumps(slots)), "array<int>")

    def encode(self, column: Column, length: int = fixed.CNN_LENGTH) -> Column:
        """Ids of the first ``length`` characters, padded to exactly that length."""
        table = self.table()

        def padded(chars):
            ids = F.transform(chars, lambda ch: F.coalesce(F.get(table, F.ascii(ch)), F.lit(fixed.UNK_ID)))
            return F.concat(ids, F.array_repeat(F.lit(fixed.PAD_ID), F.lit(length) - F.size(chars)))

        head = F.substring(F.coalesce(column, F.lit("")), 1, length)
        return text.bind(text.characters(head), padded)

    def mask(self, column: Column, length: int) -> Column:
        """1 for every position that holds a character, else 0."""
        used = F.least(F.length(F.coalesce(column, F.lit(""))), F.lit(length))
        return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used))


def encode(df: DataFrame, vocab: Vocabulary, column: str, length: int = fixed.CNN_LENGTH) -> DataFrame:
    return df.withColumn("encoded", vocab.encode(F.col(column), length))


def encode_masked(df: DataFrame, vocab: Vocabulary, column: str, length: int = fixed.MASKED_LENGTH) -> DataFrame:
    return df.withColumns(
        {
            "input_ids": vocab.encode(F.col(column), length),
            "attention_mask": vocab.mask(F.col(column), length),
        }
    )


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_chat(df: DataFrame, with_answer: bool = True) -> DataFrame:
    """Add ``messages``: the user turn and, for training, the labelled answer."""
    turns = [_turn("user", text.blank_to(F.col("content"), fixed.NO_CONTENT))]
    if with_answer:
        turns.append(_turn(fixed.ANSWER_ROLE, text.blank_to(F.col("label"), fixed.NO_LABEL)))
    return df.withColumn("messages", F.array(*turns))


def flatten_chat(messages: Column) -> Column:
    """Role and content on lines of their own, turn after turn."""
    return F.array_join(F.transform(messages, lambda m: F.concat_ws("\n", m["role"], m["content"])), "\n")


def index_labels(df: DataFrame, key: str, label: str) -> DataFrame:
    """``(label, label_id)`` from 0 in order of first appearance."""
    firsts = df.groupBy(label).agg(F.min(key).alias("at"))
    ranked = global_rank(firsts, [F.asc("at"), F.asc(label)], "label_id")
    return ranked.select(label, (F.col("label_id") - 1).cast("int").alias("label_id"))


def apply_labels(df: DataFrame, dictionary: DataFrame, label: str) -> DataFrame:
    """Add ``label_id``; labels are few, so no row moves for the lookup."""
    return df.join(dictionary, label, "left")


def name_labels(df: DataFrame, dictionary: DataFrame, label: str, id_column: str) -> DataFrame:
    """Inverse of ``index_labels``; an unknown id gets the unknown-type name."""
    names = dictionary.select(F.col("label_id").alias(id_column), F.col(label).alias("label_name"))
    named = df.join(names, id_column, "left")
    return named.withColumn("label_name", F.coalesce("label_name", F.lit(fixed.UNKNOWN_TYPE)))
