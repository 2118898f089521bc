"""Line deduplication by the spread of a line over sites.

A line that stands on many sites is boilerplate.  Per line hash a HyperLogLog
sketch of its sites is built by a mergeable aggregate.  Estimates far from the
threshold decide; lines near it get an exact distinct count.  A document that many
sites copied would spread all its lines like that, so the lines found must also stand
in many different documents, which is counted in the same way.  Only then are the
lines cut out of the documents.
"""

from pyspark.sql import Column, DataFrame, functions as F

from fraudwatch.llm.base import broadcast_if_small, free_name
from fraudwatch.session import settle

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: Registers of a sketch, as a power of two: the estimate's standard error is 1.04 / 2 ** (LG_K / 2).
LG_K = 11
#: Estimates within this share of the threshold are counted exactly: over eight standard errors.
NEAR = 0.2


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def line_key(line: Column) -> Column:
    """64-bit hash of a line without the white space around it; null for a blank line."""
    return F.when(trimmed(line) != "", F.xxhash64(trimmed(line)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def told_lines(docs: DataFrame) -> DataFrame:
    """row, site, line, n, place of every distinct line of every row, slim; place 0 is a row's longest line (ties by text)."""
    full = F.filter(F.array_distinct(F.transform(_lines(F.col("text")), trimmed)), lambda x: x != "")
    site = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sized = F.sort_array(F.transform("full", lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))), asc=False)
    # The number is given to the row before its lines are dealt out.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(site).alias("site"), full.alias("full"))
    rows = rows.select("row", "site", F.posexplode(sized).alias("place", "told"))
    return rows.select("row", "site", F.xxhash64("told.line").alias("line"), "told.n", "place")


def spread(told: DataFrame, line: str, of: str, least: int) -> DataFrame:
    """Lines with at least ``least`` distinct values of a column: by sketch, and exactly near the threshold."""
    sketched = told.groupBy(line).agg(F.count(F.lit(1)).alias("times"), F.hll_sketch_agg(of, F.lit(LG_K)).alias("sketch"))
    # A line that is met less often needs no estimate.
    estimate = F.hll_sketch_estimate("sketch")
    guessed = sketched.where(F.col("times") >= least).select(line, estimate.alias("values"))
    guessed = settle(guessed.where(F.col("values") >= least * (1 - NEAR)))
    near = broadcast_if_small(guessed.where(F.col("values") < least * (1 + NEAR)).select(line))
    pairs = told.join(near, line, "left_semi").select(line, of).distinct()
    exact = pairs.groupBy(line).agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= least)
    return guessed.where(F.col("values") >= least * (1 + NEAR)).select(line).unionByName(exact.select(line))


def bodies(told: DataFrame, candidates: DataFrame) -> DataFrame:
    """line and body of every candidate line in every row: what its document is apart from it.

    A document is known by its own lines, those that are no candidates, if they are at
    least half of the other lines or of their characters.  Else most of it stands
    elsewhere too, as in a copy that was changed here and there, and it is known by the
    longest other candidate.
    """
    marked = told.join(candidates.withColumn("spread", F.lit(True)), "line", "left")
    own = F.col("spread").isNull()
    ones = F.struct("place", "line", "n")
    # At most the document's own lines; the hashes of its own lines, taken together, stand for their set.
    rows = marked.groupBy("row").agg(
        F.collect_list(F.when(~own, ones)).alias("met"), F.bit_xor(F.when(own, F.xxhash64("line"))).alias("own_set"),
        F.count_if(own).alias("own"), F.count(F.lit(1)).alias("all"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("own_n"),
        F.sum("n").alias("all_n"))
    rows = rows.where(F.size("met") > 0).withColumn("met", F.sort_array("met"))
    first, second = F.get("met", F.lit(0))["line"], F.get("met", F.lit(1))["line"]
    each = rows.select("own_set", "own", "all", "own_n", "all_n", first.alias("first"), second.alias("second"), F.inline("met"))
    known = (2 * F.col("own") >= F.col("all") - 1) | (2 * F.col("own_n") >= F.col("all_n") - F.col("n"))
    other = F.when(F.col("line") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return each.select("line", F.xxhash64(known, F.when(known, F.col("own_set")).otherwise(other)).alias("body"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines that stand on at least ``min_sites`` distinct sites, in as many different documents."""
    told = settle(told_lines(docs))
    candidates = broadcast_if_small(spread(told, "line", "site", min_sites))
    return spread(settle(bodies(told, candidates)), "line", "body", min_sites)


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = False) -> DataFrame:
    """The rows with their boilerplate lines cut out of ``text``; all other columns stay, n_chars follows the text.

    Lines end at \\n and are compared without the white space around them; blank
    lines stay.  Null text stays null, and a row without source counts as the site
    with the empty name.  Rows may be left with an empty text; none is dropped, and
    repeated rows stay.  A document that many sites copied keeps its lines, also if it
    is a single line.  With ``counts`` the columns ``lines`` and ``lines_cut`` tell the
    lines before and the lines cut; own columns of those names are replaced.
    """
    gone = broadcast_if_small(boilerplate(docs, min_sites))
    key, cut, new = (free_name(docs, name) for name in ("cut_key", "cut_lines", "cut_text"))
    keys = F.array_compact(F.array_distinct(F.transform(_lines(F.col("text")), line_key)))
    met = docs.select(F.col("doc_id").alias(key), F.explode(keys).alias("line")).join(gone, "line", "left_semi")
    # At most the document's own lines.
    per_doc = met.groupBy(key).agg(F.collect_set("line").alias(cut))
    out = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col(key)), "left").drop(key)
    stays = F.filter(_lines(F.col("text")), lambda x: F.coalesce(~F.array_contains(F.col(cut), line_key(x)), F.lit(True)))
    touched = F.col(cut).isNotNull() & F.col("text").isNotNull()
    if counts:
        before = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
        out = out.withColumns({"lines": before, "lines_cut": F.when(touched, before - F.size(stays)).otherwise(0)})
    out = out.withColumn(new, F.when(touched, F.array_join(stays, "\n")).otherwise(F.col("text")))
    out = out.withColumn("text", F.col(new)).drop(new, cut)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
