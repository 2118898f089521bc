"""URL filter: host and path rules, then the ratio of two character language models.

Both models are variable-order Markov chains over characters with Witten-Bell
smoothing: a character is predicted from up to ORDER characters before it, and
each order leans on the next shorter one as far as its context has been seen
with different followers.  One model is fitted to URLs that the rules allow, one
to those they block.  The length-normalised difference of the two log
likelihoods is compared with a cut found on held-out URLs.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fraudwatch.llm.base import broadcast_if_small, free_name, lower_ascii
from fraudwatch.session import settle

#: Most characters of context.
ORDER = 4
#: Characters that the shortest context may be followed by, for the uniform model under it.
ALPHABET = 256
#: One of so many rule-judged URLs, by MD5, is held out to find the cut.
HELD = 5
#: Bins of the difference per unit, and the difference beyond which all counts alike.
PER_UNIT, FAR = 100, 30
START = "\u0002"

Rule = tuple[str, str, str]  # host, start of the path, verdict

#: The rules of the registered query.
RULES: list[Rule] = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What the first :// starts, up to /, ? or #, A-Z in lower case; then up to ? or #.  Both empty without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = lower_ascii(F.regexp_extract(url, pattern, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def by_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls.  A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _positions(urls: DataFrame) -> DataFrame:
    """url and gram, a character with ORDER characters before it, for every character.  Long URLs are cut in pieces first."""
    piece = 128
    padded = F.concat(F.lit(START * ORDER), F.col("url"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("url"), F.lit(1)), F.lit(piece))
    parts = urls.withColumn("at", F.explode(starts)).select(*urls.columns, F.substring(padded, F.col("at"), F.lit(piece + ORDER)).alias("part"))
    places = F.explode(F.sequence(F.lit(1), F.length("part") - ORDER))
    parts = parts.where(F.length("part") > ORDER).withColumn("at", places)
    return parts.withColumn("gram", F.substring(F.col("part"), F.col("at"), F.lit(ORDER + 1))).drop("part", "at")


def _model(grams: DataFrame) -> DataFrame:
    """gram and ratio, the difference of the logarithms that the two models give its last character."""
    shorter = F.explode(F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.struct(k.alias("k"), F.right(F.col("gram"), k).alias("tail"))))
    counts = grams.where("allowed + blocked > 0").select(shorter.alias("s"), "allowed", "blocked")
    counts = counts.groupBy("s.k", "s.tail").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    context = F.expr("left(tail, k - 1)").alias("context")
    contexts = counts.groupBy("k", context).agg(
        F.sum("allowed").alias("n_a"), F.count_if(F.col("allowed") > 0).alias("t_a"),
        F.sum("blocked").alias("n_b"), F.count_if(F.col("blocked") > 0).alias("t_b"),
    )
    orders = grams.select("gram", shorter.alias("s")).select("gram", "s.k", "s.tail").withColumn("context", context)
    # Every gram shares the empty context, whose one row is told as numbers instead of joined.
    told = ("n_a", "t_a", "n_b", "t_b")
    empty = contexts.where("k = 1").first()
    no_context = orders.where("k = 1").withColumns({c: F.lit(empty[c] if empty else None).cast("bigint") for c in told})
    met = orders.where("k > 1").join(contexts, ["k", "context"], "left").select(*no_context.columns).unionByName(no_context)
    met = met.join(counts, ["k", "tail"], "left")
    step = F.struct("k", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("allowed", "n_a", "t_a", "blocked", "n_b", "t_b")))

    def smoothed(p: Column, c: Column, n: Column, t: Column) -> Column:
        return F.when(n > 0, (c + t * p) / (n + t)).otherwise(p)

    uniform = F.struct(F.lit(1 / ALPHABET).alias("a"), F.lit(1 / ALPHABET).alias("b"))
    both = F.aggregate(
        F.array_sort("steps"), uniform,
        lambda p, s: F.struct(smoothed(p["a"], s["allowed"], s["n_a"], s["t_a"]).alias("a"), smoothed(p["b"], s["blocked"], s["n_b"], s["t_b"]).alias("b")),
        lambda p: F.ln(p["a"]) - F.ln(p["b"]),
    )
    # ORDER + 1 steps for each gram.
    return met.groupBy("gram").agg(F.collect_list(step).alias("steps")).select("gram", both.alias("ratio"))


def _cut(scored: DataFrame) -> float:
    """The least difference that is allowed: fewest errors on held-out URLs, each class counting alike; 0 without both classes."""
    place = F.round(F.greatest(F.least(F.col("score"), F.lit(FAR)), F.lit(-FAR)) * PER_UNIT).cast("int")
    bins = scored.where("held").groupBy(place.alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")
    )
    # At most 2 * FAR * PER_UNIT + 1 bins, so this window's one task has a fixed size.
    below, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    lost = F.coalesce(F.sum("good").over(below), F.lit(0)) / F.sum("good").over(every)
    passed = 1 - F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.sum("bad").over(every)
    best = bins.select("bin", (lost + passed).alias("errors")).where("errors IS NOT NULL").orderBy("errors", "bin").first()
    return (best["bin"] - 0.5) / PER_UNIT if best else 0.0


def scores(urls: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """url, verdict of the rules (or null), held, and score of every distinct URL that is not null or empty."""
    host, path = host_and_path(F.col("url"))
    _, verdict = by_rules(host, path, rules)
    one = settle(urls.select("url").where("url != ''").distinct().withColumn("verdict", verdict))
    one = one.withColumn("held", F.col("verdict").isNotNull() & (F.pmod(F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("bigint"), F.lit(HELD)) == 0))
    fitted = F.when(F.col("held"), None).otherwise(F.col("verdict"))
    places = _positions(one.select("url", fitted.alias("fitted")))
    grams = settle(places.groupBy("gram").agg(F.count_if(F.col("fitted") == "allow").alias("allowed"), F.count_if(F.col("fitted") == "block").alias("blocked")))
    model = broadcast_if_small(_model(grams))
    scored = places.select("url", "gram").join(model, "gram").groupBy("url").agg(F.round(F.avg("ratio"), 9).alias("score"))
    return one.join(scored, "url")


def judge(pages: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """All columns of pages with host, path, rule, verdict and score.

    The longest fitting rule decides; where none fits, the score does.  A null or
    empty URL has no characters to score: its score is 0.  Repeated rows stay.
    Where pages has a column named like one of the new ones, the new one takes its
    place.  Equal scores are judged alike: a score at the cut is allowed.
    """
    url = free_name(pages, "judged_url")
    known = settle(scores(pages.select(F.col("url").cast("string").alias("url")), rules))
    cut = _cut(known)
    host, path = host_and_path(F.col("url").cast("string"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "score")]
    rows = pages.select(*kept).join(known.select(F.col("url").alias(url), "score"), F.col("url").cast("string") == F.col(url), "left").drop(url)
    rows = rows.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("host", host).withColumn("path", path)
    by_score = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_score))
