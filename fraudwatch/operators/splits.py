"""Exact train/test splits without moving the corpus.

Only slim rows (group, key, tie-break) are sorted: range partitions and their
counts give every row its exact rank, whatever the keys are, so a class that owns
a third of the corpus is cut over many tasks.  Of the ranks only one row per group
is kept, the last one of the head.  These cuts are a small table, measured and then
carried to every task of the scan, which compares its rows with them: no text is
shuffled, and only the columns of group and order are read to find the cuts.  Rows
that are equal in group and order and lie across a cut are ranked by a hash of the
whole row; those alone are read in full.

A group may be null; null keys come first.  Keys may be of any orderable type.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from fraudwatch.operators.ordering import global_rank
from fraudwatch.session import broadcast_if_small, is_small, settle


def seeded_order(key: str, seed: int) -> list[Column]:
    """A repeatable shuffle: order by the md5 of key and seed, then by key."""
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)]


def _order(columns: list[Column], tie: str | None) -> Column:
    """The order as one comparable value."""
    told = [*columns, F.col(tie)] if tie else columns
    return F.struct(*(c.alias(f"o{i}") for i, c in enumerate(told)))


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns; types without a hash of their own are told as JSON."""
    hashable = lambda kind: not any(x in kind.simpleString() for x in ("map<", "variant"))
    told = [F.col(f"`{f.name}`") if hashable(f.dataType) else F.to_json(F.struct(f"`{f.name}`")) for f in df.schema.fields]
    return F.xxhash64(*told)


def sizes_of(df: DataFrame, group: str) -> DataFrame:
    """Row count of each group, a null group included."""
    return df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))


def _cuts(ranked: DataFrame, first: DataFrame, sizes: DataFrame, head: Column, few: bool) -> DataFrame:
    """g, the order value of the head's last row, rows equal to it, and how many of those belong to the head."""
    # At most one row per group, and the groups have been measured.
    small = F.broadcast if few else (lambda df: df)
    wanted = sizes.select(F.col("g").alias("g1"), head.cast("bigint").alias("k"))
    placed = first.join(wanted, F.col("g").eqNullSafe(F.col("g1"))).where("k > 0")
    ends = small(placed.select("g1", (F.col("first") + F.col("k") - 1).alias("end")))
    at = small(ranked.join(ends, F.col("all") == F.col("end")).select("g1", F.col("o").alias("cut"), "end"))
    equal = ranked.join(at, F.col("g").eqNullSafe(F.col("g1")) & (F.col("o") == F.col("cut")))
    return equal.groupBy("g1", "cut", "end").agg(F.count(F.lit(1)).alias("equal"), (F.col("end") - F.min("all") + 1).alias("inside")).drop("end")


def _label(df: DataFrame, group: str, order: Column, sizes: DataFrame, heads: dict[str, Column]) -> DataFrame:
    """Add a flag per entry of ``heads``: the row is among the first so many of its group (an expression over n)."""
    slim = df.select(F.col(group).alias("g"), order.alias("o"))
    ranked = global_rank(slim, [F.col("g"), F.col("o")], "all")
    first = settle(ranked.groupBy("g").agg(F.min("all").alias("first")))
    few = is_small(first)
    out = df.withColumn("_o", order)
    for flag, head in heads.items():
        cut = broadcast_if_small(_cuts(ranked, first, sizes, head, few))
        joined = out.join(cut, F.col(group).eqNullSafe(F.col("g1")), "left")
        split_here = F.coalesce((F.col("_o") == F.col("cut")) & (F.col("inside") < F.col("equal")), F.lit(False))
        told = joined.withColumn(flag, F.coalesce(F.col("_o") <= F.col("cut"), F.lit(False)))
        if cut.where("inside < equal").isEmpty():
            out = told.drop("g1", "cut", "equal", "inside")
            continue
        rows = joined.where(split_here)
        rows = rows.withColumn("_hash", _row_hash(df)).withColumn("_turn", F.monotonically_increasing_id())
        across = global_rank(rows, [F.col(group), F.col("_hash"), F.col("_turn")], "_all")
        start = broadcast_if_small(across.groupBy(F.col(group).alias("g2")).agg(F.min("_all").alias("_start")))
        across = across.join(start, F.col(group).eqNullSafe(F.col("g2")))
        across = across.withColumn(flag, F.col("_all") - F.col("_start") < F.col("inside")).drop("_hash", "_turn", "_all", "_start", "g2")
        out = told.where(~split_here).unionByName(across).drop("g1", "cut", "equal", "inside")
    return out.drop("_o")


def _two_parts(df, group, columns, sizes, head, tie):
    marked = _label(df, group, _order(columns, tie), sizes, {"_head": head})
    return marked.withColumn("split", F.when(F.col("_head"), "train").otherwise("test")).drop("_head")


def _share(ratio: float) -> Column:
    return F.floor(F.col("n") * F.lit(float(ratio)))


def split_head(df: DataFrame, group: str, key: str, ratio: float = 0.9, tie: str | None = None) -> DataFrame:
    """Train is the first ⌊ratio·n⌋ rows of each group in key order, test the rest."""
    return _two_parts(df, group, [F.col(key)], sizes_of(df, group), _share(ratio), tie)


def split_tail(df: DataFrame, group: str, key: str, ratio: float = 0.1, tie: str | None = None) -> DataFrame:
    """Test is the last ⌊ratio·n⌋ rows of each group, train the rest.

    A group too small for one test row is train in full.
    """
    return _two_parts(df, group, [F.col(key)], sizes_of(df, group), F.col("n") - _share(ratio), tie)


def split_gap(
    df: DataFrame, group: str, key: str, head: float = 0.9, tail: float = 0.1, tie: str | None = None
) -> DataFrame:
    """First ⌊head·n⌋ rows train, last ⌊tail·n⌋ rows test, a row between is ``none``."""
    heads = {"_head": _share(head), "_not_tail": F.col("n") - _share(tail)}
    marked = _label(df, group, _order([F.col(key)], tie), sizes_of(df, group), heads)
    label = F.when(F.col("_head"), "train").when(~F.col("_not_tail"), "test").otherwise("none")
    return marked.withColumn("split", label).drop("_head", "_not_tail")


def split_stratified(
    df: DataFrame, group: str, key: str, test_ratio: float = 0.2, seed: int = 42, tie: str | None = None
) -> DataFrame:
    """Seeded split that keeps class shares: ⌈ratio·n⌉ test rows in all.

    Each class gets the whole part of its share of the train rows; rows left over
    go to the classes with the largest remainders, then by class.
    """
    sizes = settle(sizes_of(df, group))
    overall = sizes.agg(F.sum("n")).first()[0] or 0
    train_total = overall - math.ceil(overall * test_ratio)
    share = F.col("n") * F.lit(float(train_total)) / F.lit(float(max(overall, 1)))
    shares = sizes.withColumn("whole", F.floor(share)).withColumn("part", F.round(share - F.floor(share), 9))
    left = train_total - (shares.agg(F.sum("whole")).first()[0] or 0)
    turns = global_rank(shares, [F.desc("part"), F.col("g")], "turn")
    train = turns.select("g", "n", (F.col("whole") + (F.col("turn") <= left).cast("int")).alias("train"))
    return _two_parts(df, group, seeded_order(key, seed), train, F.col("train"), tie)


def split_shuffled(
    df: DataFrame, group: str, key: str, test_ratio: float = 0.1, seed: int = 42, tie: str | None = None
) -> DataFrame:
    """Shuffle each file with a seed; train is the first ⌊(1 - ratio)·n⌋ rows."""
    return _two_parts(df, group, seeded_order(key, seed), sizes_of(df, group), _share(1.0 - test_ratio), tie)


def split_summary(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group, "split").agg(F.count(F.lit(1)).alias("n"))
