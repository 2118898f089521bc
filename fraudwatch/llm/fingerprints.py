"""Document fingerprints by consistent weighted sampling (Ioffe's gamma-based form).

For each of SAMPLES draws every term gets, from its hash alone, r and c from
Gamma(2, 1) and b uniform in [0, 1).  With t = floor(ln w / r + b) and
ln y = r (t - b), the draw takes the term with the least ln a = ln c - ln y - r.
Two documents draw the same (term, t), and so the same a, with a probability
equal to their generalised Jaccard similarity, sum of min over sum of max weight.
The least a names the draw, so a fingerprint is SAMPLES minima: an aggregate.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Draws of a fingerprint.
SAMPLES = 32
#: Hex digits that a draw takes in the fingerprint.
DIGITS = 4
SEED = 20
#: Ranges of documents per shuffle partition.
SPREAD = 4


def words(text: Column) -> Column:
    """Terms: runs without white space, in lower case."""
    return F.split(F.lower(text), r"\s+")


def draw(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of one term in draw k, from two hashes cut into five uniform numbers."""
    x, y = F.xxhash64(term, F.lit(SEED + 2 * k)), F.xxhash64(term, F.lit(SEED + 2 * k + 1))

    def uniform(bits: Column, shift: int, n: int) -> Column:
        return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << n) - 1)) + 0.5) / float(1 << n)

    r = -F.ln(uniform(x, 0, 21) * uniform(x, 21, 21))
    b = uniform(x, 42, 21)
    c = F.ln(-F.ln(uniform(y, 0, 32) * uniform(y, 32, 32)))
    return c - r * (F.floor(log_weight / r + b) - b + 1)


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and sig, the array of draws, from rows (keys, term hash, weight); one term of a document is one row."""
    weighted = terms.withColumn("log_weight", F.ln("weight"))
    least = [F.min(draw(F.col("term"), F.col("log_weight"), k)).alias(f"_{k}") for k in range(samples)]
    found = weighted.groupBy(*keys).agg(*least)
    code = [F.xxhash64(f"_{k}").bitwiseAND(F.lit(16**DIGITS - 1)).cast("int") for k in range(samples)]
    return found.select(*keys, F.array(*code).alias("sig"))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal draws."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.size(a)


def term_rows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, term, weight) of texts (keys, text): a term's weight is its count times its length.

    A text without terms has one row with nulls.
    """
    told = texts.select(*keys, F.explode(words(F.col("text"))).alias("word"))
    told = told.select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"), F.length("word").alias("size"))
    counted = told.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return counted.select(*keys, "term", F.when(F.col("term").isNotNull(), (F.col("n") * F.col("size")).cast("double")).alias("weight"))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of every row.

    Null text counts as empty; texts without words share one fingerprint.  Equal
    texts have equal fingerprints; rows with equal doc_id and text are one row.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("same", F.xxhash64("text")).dropDuplicates(["doc_id", "same"])
    found = signatures(term_rows(keyed, ["doc_id", "same"]), ["doc_id", "same"], samples)
    return found.select("doc_id", as_text(F.col("sig")).alias("fingerprint"))


def _parts(rows: DataFrame) -> int:
    """Ranges of documents: more than shuffle partitions, as a text's terms take several times its bytes."""
    return SPREAD * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _buckets(rows: DataFrame) -> DataFrame:
    """Rows with a bucket: ranges of doc_id, nulls first."""
    parts = _parts(rows)
    shares = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []
    cuts = F.array(*(F.lit(b) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<bigint>")
    return rows.withColumn("bucket", F.size(F.filter(cuts, lambda b: b < F.col("place"))))


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, turn, guard, doc_id, text and the next row's text, rows in order of doc_id (nulls first), then text.

    After the last row comes the first.  Rows are ordered within ranges of doc_id;
    each range also gets a guard, the first row of the next one, to look ahead to.
    """
    least = F.lit(-(1 << 63))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = _buckets(rows.withColumn("place", F.coalesce("doc_id", least))).withColumn("same", F.xxhash64("text"))
    # One row for each bucket.
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("place", "same")).alias("f")).select("bucket", "f.*").orderBy("bucket").collect()
    spark = docs.sparkSession
    onto = [(r["place"], r["same"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    wanted = spark.createDataFrame(onto, "place bigint, same bigint, onto int")
    guards = placed.join(F.broadcast(wanted), ["place", "same"]).dropDuplicates(["onto"])
    both = placed.withColumn("guard", F.lit(0)).unionByName(guards.withColumn("bucket", F.col("onto")).drop("onto").withColumn("guard", F.lit(1)))
    # A stated number of partitions is kept as it is: merged ones would not hold their terms in memory.
    both = both.repartition(_parts(docs), "bucket")
    order = Window.partitionBy("bucket").orderBy("guard", "place", "same")
    return both.select(
        "bucket", F.row_number().over(order).alias("turn"), "guard", "doc_id", "text", F.lead("text").over(order).alias("next_text")
    )


def compare(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many, or all, of the next document.  near_edited and near_next are
    the shares of draws that the fingerprint has in common with the edited text's
    and with the next document's.  Null text is empty.  Rows with equal doc_id are
    ordered by a hash of their text; repeated rows stay.
    """
    rows = with_next(docs)
    n = F.length("text")
    half = F.shiftright(n, 1)
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("bucket", "turn", "guard", "doc_id", n.cast("bigint").alias("n_chars"), "text", F.coalesce(edited, F.lit("")).alias("edited"))
    plain = F.struct("text", F.lit(None).cast("binary").alias("sha"))
    sides = F.array(plain, F.struct(F.col("edited").alias("text"), F.unhex(F.sha2("edited", 256)).alias("sha")))
    both = rows.select("bucket", "turn", "guard", "doc_id", "n_chars", F.posexplode(sides).alias("side", "s"))
    # All grouping below is within a bucket, so the texts are shuffled once, by bucket.
    keys = ["bucket", "turn", "guard", "doc_id", "n_chars", "side", "sha"]
    found = signatures(term_rows(both.select(*keys[:-1], "s.sha", "s.text"), keys), keys, samples)
    one = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    met = found.groupBy("bucket", "turn", "guard").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.lower(F.hex(one("sha", 1))).alias("edited_sha256"),
        one("sig", 0).alias("sig"), one("sig", 1).alias("edited_sig"),
    )
    after = F.lead("sig").over(Window.partitionBy("bucket").orderBy("turn"))
    met = met.withColumn("next_sig", after).where("guard = 0")
    return met.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
