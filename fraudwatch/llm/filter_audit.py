"""How text filters interact: what each removes in every order of application.

Every document becomes a mask of the filters it fails, and the corpus a table of
cells: rows per part and mask.  From there a Gray-code walk visits all subsets of
filters and toggles one filter at a time.  Each mask cell keeps a counter of the
active filters it fails; a counter that leaves zero takes its cell's rows out of
the running survivors, one that comes back to zero returns them.  The survivors of
every subset are stored, and each step of each order is a difference of two states.
"""

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fraudwatch.llm.base import shipped
from fraudwatch.session import settle

shipped(__name__)

SPACE = " \t\n\x0b\x0c\r"
#: The filter that looks at the whole table; the others look at one text.
REPEATED = "E"
#: Parts whose orders a task writes at once.
PARTS_AT_ONCE = 64
COUNTS = ["n", "good", "toxic"]


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text: too short, repetitive, many capitals, odd signs."""
    whole = F.btrim(text, F.lit(SPACE))
    words = F.split(whole, r"[\x20\x09-\x0D]+")
    # A blank text splits into one empty word.
    blank = (whole == "").cast("int")
    n, distinct = F.size(words) - blank, F.size(F.array_distinct(words)) - blank
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    capitals = F.length(text) - F.length(F.translate(text, letters, ""))
    return {
        "A": n < 200,
        "B": F.lit(100) * distinct < F.lit(50) * n,
        "C": F.lit(100) * capitals > F.lit(2) * F.length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def cells(docs: DataFrame, labels: DataFrame, filters=text_filters) -> DataFrame:
    """part, mask and how many rows (all, good, toxic) of the part fail just the filters of the mask.

    Bit i of the mask is the i-th letter; the last bit is the filter of repeated texts.
    Texts are compared by their SHA-256.  Rows shrink to a few numbers before anything
    is shuffled, and equal rows are added up before each shuffle, so a text or a part
    that owns a third of the rows is one row per task.
    """
    text = F.coalesce("text", F.lit(""))
    conditions = filters(text)
    mask = sum(((c.cast("int") * F.lit(1 << i)) for i, c in enumerate(conditions.values())), F.lit(0))
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("text_key"), mask.alias("mask"),
    )
    # Rows without an id have no label; their texts keep them from meeting in one task.
    slim = slim.withColumn("spare", F.when(F.col("doc_id").isNull(), F.xxhash64("text_key")).otherwise(F.lit(0).cast("bigint")))
    slim = slim.groupBy("doc_id", "spare", "part", "text_key", "mask").agg(F.count(F.lit(1)).alias("n"))
    says = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = slim.join(says.withColumn("spare", F.lit(0).cast("bigint")), ["doc_id", "spare"], "left")
    count = {c: F.col("n") * F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")}
    told = told.select("doc_id", "part", "text_key", "mask", "n", *(v.alias(c) for c, v in count.items()))
    # Of each text and part: its rows, its rows without an id, and the rows with its smallest id.
    smallest = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *COUNTS))
    texts = settle(told.groupBy("text_key", "part", "mask").agg(
        *(F.sum(c).alias(c) for c in COUNTS),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(smallest).alias("first"),
    ))
    least = texts.groupBy("text_key").agg(F.min("first.doc_id").alias("least"))
    met = texts.join(least, "text_key")
    stands = F.coalesce(F.col("first.doc_id") == F.col("least"), F.lit(False))
    passing = {c: F.when(stands, F.col(f"first.{c}")).otherwise(0) for c in COUNTS}
    passing["n"] = passing["n"] + F.col("unnamed")
    bit = 1 << len(conditions)
    entry = lambda mask, value: F.struct(mask.alias("mask"), *(value(c).alias(c) for c in COUNTS))
    both = F.array(entry(F.col("mask"), lambda c: passing[c]), entry(F.col("mask") + bit, lambda c: F.col(c) - passing[c]))
    split = met.select("part", F.inline(both))
    return split.groupBy("part", "mask").agg(*(F.sum(c).cast("bigint").alias(c) for c in COUNTS))


def walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters, from counts[part, mask, kind]; the result is [subset, part, kind]."""
    masks = np.arange(counts.shape[1])
    failing = np.zeros(len(masks), np.int64)
    survivors = counts.sum(axis=1)
    states = np.empty((len(masks), *survivors.shape), np.int64)
    states[0] = survivors
    active = 0
    for turn in range(1, len(masks)):
        bit = turn & -turn
        active ^= bit
        touched = (masks & bit) != 0
        if active & bit:
            survivors = survivors - counts[:, touched & (failing == 0)].sum(axis=1)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            survivors = survivors + counts[:, touched & (failing == 0)].sum(axis=1)
        states[active] = survivors
    return states


SCHEMA = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def _orders(letters: str):
    """Names of all orders, and the bit and the active filters before each of their steps."""
    orders = list(permutations(range(len(letters))))
    bits = 1 << np.array(orders)
    return ["".join(letters[i] for i in o) for o in orders], bits, np.cumsum(bits, axis=1) - bits


def steps(batches: Iterator[pa.RecordBatch], letters: str) -> Iterator[pa.RecordBatch]:
    """Rows of (part, cells) to one row per part, order and step."""
    names, bits, before = _orders(letters)
    width, every = len(letters), (1 << len(letters)) - 1
    for batch in batches:
        for start in range(0, batch.num_rows, PARTS_AT_ONCE):
            rows = batch.slice(start, PARTS_AT_ONCE).to_pylist()
            counts = np.zeros((len(rows), 1 << width, len(COUNTS)), np.int64)
            for i, row in enumerate(rows):
                for cell in row["cells"]:
                    counts[i, cell["mask"]] = [cell[c] for c in COUNTS]
            states = walk(counts)
            lost = states[before] - states[before + bits]  # order, step, part, kind
            fails = (states[0] - states[1 << np.arange(width)])[..., 0]  # filter, part
            alone = (states[every - (1 << np.arange(width))] - states[every])[..., 0]
            which = np.log2(bits).astype(int)
            shapley = np.stack([lost[..., 0][which == f].sum(axis=0) for f in range(width)])
            told = [
                states[before + bits][..., 0], lost[..., 0], fails[which] - lost[..., 0], alone[which],
                lost[..., 1], lost[..., 2], shapley[which],
            ]
            columns = [np.moveaxis(x, 2, 0).ravel() for x in told]
            per = len(names) * width
            yield pa.record_batch([
                pa.array([r["part"] for r in rows for _ in range(per)], pa.string()),
                pa.array([n for n in names for _ in range(width)] * len(rows), pa.string()),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(names) * len(rows))),
                *(pa.array(x, pa.int64()) for x in columns),
            ], names=[x.split()[0] for x in SCHEMA.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, filters=text_filters) -> DataFrame:
    """One row per part (source), order of the filters and step: what the step keeps, removes and costs.

    ``filters`` gives the failure conditions of a text by letter; the filter of
    repeated texts, a text that a smaller doc_id has as well, comes last.  A null text
    is an empty one, a null source the part with the empty name.  A row without doc_id
    has no label, repeats nothing and is repeated by none; repeated rows (one id, one
    text) count each, and none of them is the other's copy.  A document is good or
    toxic if any of its label rows says so.  A table without rows has no part.
    Other columns are not read, whatever their names.  A part has at most a cell per
    mask, so nothing here grows with the documents but the two slim aggregations.
    """
    letters = "".join(filters(F.lit(""))) + REPEATED
    if len(letters) > 6:
        raise ValueError(f"{factorial(len(letters))} orders are too many to list")
    table = cells(docs, labels, filters)
    # At most one cell per mask.
    packed = table.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    return packed.mapInArrow(lambda batches: steps(batches, letters), SCHEMA)
