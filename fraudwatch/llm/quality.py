"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text (labelled good) and
one of all raw text, give every document the logarithm of its importance weight,
log p_target - log p_raw.  The n-grams are words, pairs of words, and runs of up to
three word shapes (case, digits, marks, the word before once more).  Documents are drawn without
replacement in proportion to their weights: Gumbel noise is added to the
logarithm and the k largest stay.  k is the number of documents whose weight
lies on the target's side of a cut found on held-out labelled documents.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fraudwatch.llm.base import CACHE_WORDS, WordHashes, blocks, mix, shipped, small_batches, tidied, word_array
from fraudwatch.session import settle

shipped(__name__)

#: Labelled documents used at most, those with the smallest hashes; half of them fit, half find the cut.
LABELLED_ROWS = 50_000
#: Cells of the hashed n-gram models, the first of them for shapes.
CELLS = 1 << 15
#: Occurrences by which a cell's target count is drawn towards what raw text would give.
PRIOR = 50.0
SEED = 7
#: Bins of a pass that looks for the k-th largest value.
BINS = 1024

TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Model:
    """Logarithm of target over raw probability for every cell."""

    ratios: np.ndarray


#: Shapes of a word, and how many cells their runs of one to three take.
LOWER, TITLE, UPPER, MIXED, MARK, MARKS, AGAIN = range(7)
SHAPES = 8 + 64 + 512


def shape_of(word: str) -> int:
    if word.isalpha():
        return LOWER if word.islower() else UPPER if word.isupper() and len(word) > 1 else TITLE if word[1:].islower() or len(word) == 1 else MIXED
    return MIXED if word[0].isalnum() else MARK if len(word) == 1 else MARKS


class ShapedHashes(WordHashes):
    """61 bits of a lower-cased word's hash with its shape in the lowest three."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower()) & ~7 | shape_of(word)
        return value


def cells(hashes: ShapedHashes, text: str | None, size: int = CELLS) -> np.ndarray:
    """Cells of a text's words, pairs of neighbours, and runs of one to three shapes, marks apart from letters."""
    both = word_array(hashes, TOKEN.findall(text or ""))
    shape, words = (both & np.uint64(7)).astype(np.int64), both >> np.uint64(3)
    shape[1:][words[1:] == words[:-1]] = AGAIN
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    hashed = SHAPES + (np.concatenate([mix(words), pairs]) >> np.uint64(20)).astype(np.int64) % (size - SHAPES)
    two = shape[:-1] * 8 + shape[1:]
    return np.concatenate([hashed, shape, 8 + two, 72 + two[:-1] * 8 + shape[2:]])


def labelled(labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, good and held (for the cut) of at most ``most`` labelled documents.

    A document with several labels is good only if all of them say so; null ids
    and null labels are left out.
    """
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    one = rows.agg((F.min("quality") > 0).alias("good")).withColumn("turn", F.xxhash64(F.lit(SEED), "doc_id"))
    return one.orderBy("turn", "doc_id").limit(most).select("doc_id", "good", (F.col("turn") % 2 == 0).alias("held"))


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.join(F.broadcast(labelled(labels)), "doc_id", "left")


def fit(docs: DataFrame, labels: DataFrame, size: int = CELLS) -> Model:
    """Count all documents for the raw model and the good ones that are not held out for the target model.

    The model is one number a cell, so what reaches the driver has a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ShapedHashes()
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in blocks(batches, "text"):
            columns = (batch.column(c).to_pylist() for c in ("text", "good", "held"))
            for text, good, held in zip(*columns):
                found = np.bincount(cells(hashes, text, size), minlength=size)
                raw += found
                if good and not held:
                    target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["cell", "raw", "target"])

    counts = _marked(docs, labels).mapInArrow(tidied(run), "cell bigint, raw bigint, target bigint")
    with small_batches(docs.sparkSession):
        found = counts.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(size), np.zeros(size)
    raw[found["cell"]], target[found["cell"]] = found["raw"], found["target"]
    if not target.sum():  # without good documents nothing tells the models apart
        return Model(np.zeros(size))
    # Where little has been seen, the target model leans on the raw one.
    expected = raw * (target.sum() / raw.sum())
    return Model(np.log(target + PRIOR) - np.log(expected + PRIOR))


def noise(doc_id: int | None, text: str | None, seed: int = SEED) -> float:
    """Gumbel noise that depends on the row alone, so that a task run again draws the same."""
    bits = xxhash.xxh3_64_intdigest(f"{doc_id}\n{text or ''}", seed) >> 11
    return -math.log(-math.log((bits + 0.5) / (1 << 53)))


def _weights(hashes: ShapedHashes, model: Model, batch: pa.RecordBatch) -> tuple[list[float], list[float]]:
    weights, noisy = [], []
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        weight = float(model.ratios[cells(hashes, text, len(model.ratios))].sum())
        weights.append(weight)
        noisy.append(weight + noise(doc_id, text))
    return weights, noisy


def score(docs: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """doc_id, good and held of labelled documents, log_weight and noisy (with Gumbel noise) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ShapedHashes()
        for batch in blocks(batches, "text"):
            weights, noisy = _weights(hashes, model, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("good"), batch.column("held"), pa.array(weights, pa.float64()), pa.array(noisy, pa.float64())],
                names=["doc_id", "good", "held", "log_weight", "noisy"],
            )

    return _marked(docs, labels).mapInArrow(tidied(run), "doc_id bigint, good boolean, held boolean, log_weight double, noisy double")


def cut_of(scored: DataFrame) -> float:
    """The log weight that parts held-out good from other documents with the fewest errors, each class counting alike.

    Weights are counted in bins of an inverse hyperbolic sine, a few thousand at
    most.  Without both classes the cut lets everything pass.
    """
    bins = scored.where("held").groupBy(F.round(F.asinh("log_weight") * 50).cast("int").alias("bin")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    ).orderBy("bin").toPandas()
    good, bad = bins["good"].sum(), bins["bad"].sum()
    if not good or not bad:
        return -math.inf
    kept_bad = bins["bad"][::-1].cumsum()[::-1] / bad
    lost_good = (bins["good"].cumsum() - bins["good"]) / good
    errors = (kept_bad + lost_good).to_numpy()
    errors = np.append(errors, 1.0)  # the cut above all bins
    best = int(np.flatnonzero(errors <= errors.min() + 1e-12)[0])
    if best == 0:
        return -math.inf
    edges = bins["bin"].to_numpy()
    high = edges[best] if best < len(edges) else edges[-1] + 1
    return math.sinh((edges[best - 1] + high) / 2 / 50)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value: bins are counted, then the bin that holds it is looked at more closely."""
    value = F.col(column)
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    while lo is not None and lo < hi:
        step = (hi - lo) / BINS
        place = F.least(F.floor((value - lo) / step), F.lit(BINS - 1))
        found = df.where(value.between(lo, hi)).groupBy(place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
        ).orderBy(F.desc("bin")).collect()
        if len(found) == 1 and (found[0]["lo"], found[0]["hi"]) == (lo, hi) and step == 0:
            break
        for row in found:
            if k <= row["n"]:
                lo, hi = row["lo"], row["hi"]
                break
            k -= row["n"]
    return -math.inf if lo is None else lo


@dataclass(frozen=True)
class Classifier:
    """The fitted model with its cut, and the least noisy log weight that stays."""

    model: Model
    cut: float
    least: float
    scored: DataFrame


def classifier(docs: DataFrame, labels: DataFrame) -> Classifier:
    model = fit(docs, labels)
    with small_batches(docs.sparkSession):
        scored = settle(score(docs, labels, model))
    cut = cut_of(scored)
    k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    least = kth_largest(scored, "noisy", k) if k else math.inf
    return Classifier(model, cut, least, scored)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight and keep of every row.

    A null or empty text has weight 0 before noise.  Rows that share doc_id and
    text share their noise and so their fate, also where the k-th place falls
    among them.  Null ids are scored like others.  Tables without rows give none;
    without labels of both kinds every row is kept.
    """
    found = classifier(docs, labels)
    return found.scored.select("doc_id", "log_weight", (F.col("noisy") >= F.lit(found.least)).alias("keep"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier draws, with all their columns."""
    found = classifier(docs, labels)
    model, least = found.model, found.least
    names = docs.schema.names
    doc_id, text = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ShapedHashes()
        for batch in blocks(batches, "text"):
            slim = pa.RecordBatch.from_arrays([batch.column(doc_id), batch.column(text)], names=["doc_id", "text"])
            _, noisy = _weights(hashes, model, slim)
            yield batch.filter(pa.array([x >= least for x in noisy], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
