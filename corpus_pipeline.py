"""From raw documents to packed training sequences: classify, drop boilerplate lines, drop near copies, pack."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fraudwatch.llm import jaccard_join, line_dedup, packing, quality
from fraudwatch.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier draws; the labels table says what good text is."""
    return quality.keep(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites; null texts stay null, a document may be left empty."""
    return line_dedup.drop_boilerplate(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest doc_id.

    Repeated rows become one.  A row without doc_id stays if a row without doc_id
    is all that some group has.
    """
    components = jaccard_join.components(docs)
    kept = components.where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    one = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return one.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of tokens: their token ids, with their documents' ids; a null or empty text is its end id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", near_copies),
    ("packing", pack),
]

#: Neither the classifier's models nor the tokenizer's ids have an SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for step, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{step}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
