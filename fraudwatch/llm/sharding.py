"""Shards by extendible hashing.

A row's bucket is named by leading bits of its hash.  Only a bucket that holds
more bytes than a shard may is split, on one more bit, until every bucket fits;
the directory of buckets is a table.  Sums of bytes by prefix are aggregates, so
no bucket's rows are ever gathered.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from fraudwatch.llm.base import free_name
from fraudwatch.operators.ordering import global_rank
from fraudwatch.session import settle

#: Most bytes of text in a shard.
LIMIT_BYTES = 16 * 1024 * 1024
#: Hash bits that can be told apart.
BITS = 60
#: Levels of the directory that one pass over the hashes looks at beyond the expected depth.
AHEAD = 4


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of id and text: only equal rows share all of them."""
    told = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("bigint")


def _sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    return docs.select(F.col("doc_id"), row_hash(F.col("doc_id"), text).alias("hash"), size.alias("bytes"))


def directory(sized: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """depth, prefix, shard_bytes and rows of every bucket: the shortest prefixes whose bytes fit.

    A prefix of all 60 bits is not split further: its rows are copies of one row.
    """
    pending = sized.groupBy("hash").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + AHEAD)
    leaves = None
    while True:
        cells = pending.groupBy(F.shiftright("hash", BITS - high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        depth = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        sums = cells.select(depth, "cell", "bytes", "rows")
        prefix = F.expr(f"shiftright(cell, {high} - depth)").alias("prefix")
        sums = settle(sums.groupBy("depth", prefix).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("rows")))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)
        fit = sums.where(fits)
        above = fit.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("over"))
        found = fit.withColumn("over", F.shiftright("prefix", 1)).join(above, ["depth", "over"], "left_anti").drop("over")
        leaves = found if leaves is None else leaves.unionByName(found)
        full = sums.where((F.col("depth") == high) & ~fits).select(F.col("prefix").alias("cell"))
        if full.isEmpty():
            return leaves.select("depth", "prefix", "shard_bytes", "rows")
        pending = pending.withColumn("cell", F.shiftright("hash", BITS - high)).join(full, "cell", "left_semi").drop("cell")
        low, high = high + 1, min(BITS, high + 2 * AHEAD)


def shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, hash, bytes, shard, depth and shard_bytes of every row.

    ``shard`` spells the bucket's bits (an empty name where one shard holds all).
    Null text counts no bytes.  A single row above the limit is a shard of its own.
    Copies of one row share all bits; where together they exceed the limit they are
    numbered and dealt to pages ``bits+0``, ``bits+1`` and so on that fit.
    """
    sized = settle(_sized(docs))
    leaves = settle(directory(sized, limit))
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # 61 at most
    tried = sized.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in depths or [0]))))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(hash, {BITS} - depth)"))
    placed = tried.join(leaves, ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    placed = placed.withColumn("shard", name)
    crowded = (F.col("shard_bytes") > limit) & (F.col("rows") > 1)
    out = ["doc_id", "hash", "bytes", "shard", "depth", "shard_bytes"]
    many = leaves.where(crowded)
    if many.isEmpty():
        return placed.select(*out)
    per_page = F.greatest(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(1))
    ranked = global_rank(placed.where(crowded).withColumn("_turn", F.monotonically_increasing_id()), [F.col("hash"), F.col("_turn")], "_rank")
    first = ranked.groupBy("hash").agg(F.min("_rank").alias("_first"))
    paged = ranked.join(first, "hash").withColumn("_n", F.col("_rank") - F.col("_first")).withColumn("_page", F.floor(F.col("_n") / per_page))
    here = F.least(per_page, F.col("rows") - F.col("_page") * per_page)
    paged = paged.withColumn("shard", F.concat("shard", F.lit("+"), F.col("_page").cast("string"))).withColumn("shard_bytes", here * F.col("bytes"))
    return placed.where(~crowded).select(*out).unionByName(paged.select(*out))


def write(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write the rows as Parquet in one folder for each shard, ``shard=b<bits>``; rows of a shard are written by one task.

    Copies of one row that exceed the limit together are dealt to the folders
    ``b<bits>+0``, ``b<bits>+1`` and so on, as ``shards`` names them.  A column named
    like the folder's is not kept.
    """
    sized = settle(_sized(docs))
    leaves = settle(directory(sized, limit))
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # 61 at most
    key, page, turn, first, per = (free_name(docs, n) for n in ("row_hash", "row_page", "row_turn", "row_first", "row_per"))
    slim = sized.select("hash").distinct().withColumn("depth", F.explode(F.array(*(F.lit(d) for d in depths or [0]))))
    slim = slim.withColumn("prefix", F.expr(f"shiftright(hash, {BITS} - depth)")).join(leaves, ["depth", "prefix"])
    bits = F.concat(F.lit("b"), F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')")))
    crowded = (F.col("shard_bytes") > limit) & (F.col("rows") > 1)
    # Copies of one row are equally long; 0 where a shard has one page.
    fit = F.when(crowded, F.greatest(F.floor(F.lit(limit) * F.col("rows") / F.col("shard_bytes")), F.lit(1))).otherwise(F.lit(0))
    named = slim.select(F.col("hash").alias(key), bits.alias("shard"), fit.alias(per))
    rows = docs.drop("shard").withColumn(key, row_hash(F.col("doc_id"), F.col("text").cast("string"))).join(named, key)
    out = rows.where(F.col(per) == 0).drop(key, per)
    if not leaves.where(crowded).isEmpty():
        copies = rows.where(F.col(per) > 0).withColumn(turn, F.monotonically_increasing_id())
        ranked = global_rank(copies, [F.col(key), F.col(turn)], page)
        ranked = ranked.join(ranked.groupBy(key).agg(F.min(page).alias(first)), key)
        number = F.floor((F.col(page) - F.col(first)) / F.col(per)).cast("string")
        out = out.unionByName(ranked.withColumn("shard", F.concat("shard", F.lit("+"), number)).drop(key, per, page, turn, first))
    out.repartition("shard").write.partitionBy("shard").parquet(path)
