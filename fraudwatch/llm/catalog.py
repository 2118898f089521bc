"""Registered queries of the training-data operators, with DuckDB SQL where it can state them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fraudwatch.llm import (
    exact_dedup, filter_audit, fingerprints, html_text, jaccard_join, line_dedup, packing, periodic_runs, pieces, quality, search, sharding,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _url_sql() -> str:
    """Rules, both models order by order, the held-out cut, and the verdicts."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda i: " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[i]}'" for h, p, v in rules)
    orders = range(1, url_filter.ORDER + 2)
    joins = " ".join(
        f"LEFT JOIN t t{k} ON t{k}.k = {k} AND t{k}.tail = right(g.gram, {k}) "
        f"LEFT JOIN c c{k} ON c{k}.k = {k} AND c{k}.context = left(right(g.gram, {k}), {k - 1})" for k in orders
    )
    step = lambda m, k: (
        f"CASE WHEN c{k}.n{m} > 0 THEN (coalesce(t{k}.{m}, 0) + c{k}.t{m} * {m}{k - 1}) / (c{k}.n{m} + c{k}.t{m}) ELSE {m}{k - 1} END AS {m}{k}"
    )
    steps = ", ".join(step(m, k) for k in orders for m in "ab")
    host = "'^.*?://([^/?#]*)([^?#]*)'"
    return f"""
WITH h AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, {host}, 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, {host}, 2, 's'), '') AS path FROM pages),
j AS (SELECT *, CASE {case(0)} END AS rule, CASE {case(1)} END AS says FROM h),
u AS (SELECT DISTINCT url, says, says IS NOT NULL AND ('0x' || left(md5(url), 8))::BIGINT % {url_filter.HELD} = 0 AS held FROM j WHERE url <> ''),
p AS (SELECT url, CASE WHEN NOT held THEN says END AS fitted, substr(repeat(chr(2), {url_filter.ORDER}) || url, i, {url_filter.ORDER + 1}) AS gram
  FROM u, LATERAL unnest(range(1, length(url) + 1)) x(i)),
g AS (SELECT gram, count(*) FILTER (fitted = 'allow') AS a, count(*) FILTER (fitted = 'block') AS b FROM p GROUP BY gram),
t AS (SELECT k, right(gram, k::INT) AS tail, sum(a) AS a, sum(b) AS b FROM g, range(1, {url_filter.ORDER + 2}) r(k) WHERE a + b > 0 GROUP BY ALL),
c AS (SELECT k, left(tail, k::INT - 1) AS context, sum(a) AS na, count(*) FILTER (a > 0) AS ta, sum(b) AS nb, count(*) FILTER (b > 0) AS tb
  FROM t GROUP BY ALL),
m AS (SELECT g.gram, 1.0::DOUBLE / {url_filter.ALPHABET} AS a0, 1.0::DOUBLE / {url_filter.ALPHABET} AS b0, {steps},
    ln(a{orders[-1]}) - ln(b{orders[-1]}) AS ratio FROM g {joins}),
s AS (SELECT url, round(avg(ratio), 9) AS score FROM p JOIN m USING (gram) GROUP BY url),
b AS (SELECT round(greatest(least(score, {url_filter.FAR}), -{url_filter.FAR}) * {url_filter.PER_UNIT})::INT AS bin,
    count(*) FILTER (says = 'allow') AS good, count(*) FILTER (says = 'block') AS bad FROM s JOIN u USING (url) WHERE held GROUP BY bin),
e AS (SELECT bin, coalesce(sum(good) OVER w, 0)::DOUBLE / nullif(sum(good) OVER (), 0)
    + (1 - coalesce(sum(bad) OVER w, 0)::DOUBLE / nullif(sum(bad) OVER (), 0)) AS errors
  FROM b WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT (bin - 0.5) / {url_filter.PER_UNIT} FROM e WHERE errors IS NOT NULL ORDER BY errors, bin LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule,
  coalesce(says, CASE WHEN coalesce(score, 0) >= cut THEN 'allow' ELSE 'block' END) AS verdict, round(coalesce(score, 0), 6) AS score
FROM j LEFT JOIN s ON s.url = j.url, cut
"""


@query("op1_url_filter", _url_sql())
def op1(spark, folder):
    judged = url_filter.judge(table(spark, folder, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


@query("op2_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS shingles
  FROM w),
t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT s.doc_id, len(any_value(shingles)) AS n_shingles, min(r) AS component_id
FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id
""")
def op2(spark, folder):
    return jaccard_join.components(table(spark, folder, "documents"))


@query("op3_packing")
def op3(spark, folder):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack(table(spark, folder, "documents"), vocabulary)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_sharding", f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
    CAST(('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 15)) AS BIGINT) AS hash
  FROM documents),
s AS (
  SELECT depth, hash >> (60 - depth) AS prefix, sum(bytes) AS shard_bytes FROM h, range(0, 61) r(depth) GROUP BY ALL),
leaf AS (
  SELECT doc_id, hash, bytes, min(s.depth) AS depth
  FROM h JOIN s ON s.prefix = hash >> (60 - s.depth) AND (shard_bytes <= {sharding.LIMIT_BYTES} OR s.depth = 60) GROUP BY ALL)
SELECT doc_id, bytes, CASE WHEN leaf.depth = 0 THEN '' ELSE left(lpad(bin(hash), 60, '0'), leaf.depth::INT) END AS shard,
  leaf.depth::INT AS depth, shard_bytes::BIGINT AS shard_bytes
FROM leaf JOIN s ON s.depth = leaf.depth AND s.prefix = hash >> (60 - leaf.depth)
""")
def op4(spark, folder):
    return sharding.shards(table(spark, folder, "documents")).drop("hash")


LINES = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
f AS (SELECT row, coalesce(source, '') AS site, list_filter(list_distinct(list_transform(ls, lambda x:
    trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)))), lambda x: x <> '') AS full_lines FROM d),
u AS (SELECT row, site, unnest(full_lines) AS line FROM f),
c AS (SELECT line FROM u GROUP BY line HAVING count(DISTINCT site) >= {sites}),
m AS (SELECT u.row, u.line, length(u.line) AS n, c.line IS NOT NULL AS spread FROM u LEFT JOIN c USING (line)),
r AS (SELECT row, list(line ORDER BY line) FILTER (NOT spread) AS own, count(*) FILTER (NOT spread) AS own_lines, count(*) AS all_lines,
    coalesce(sum(n) FILTER (NOT spread), 0) AS own_n, sum(n) AS all_n, list(line ORDER BY n DESC, line DESC) FILTER (spread) AS met FROM m GROUP BY row),
b AS (SELECT m.line, CASE WHEN 2 * own_lines >= all_lines - 1 OR 2 * own_n >= all_n - n THEN 'own' || coalesce(array_to_string(own, chr(10)), '')
    ELSE 'met' || CASE WHEN m.line = met[1] THEN met[2] ELSE met[1] END END AS body FROM m JOIN r USING (row) WHERE spread),
gone AS (SELECT line FROM b GROUP BY line HAVING count(DISTINCT body) >= {sites}),
x AS (SELECT doc_id, text, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, text, i, x.line, gone.line IS NULL AS stays
  FROM x LEFT JOIN gone ON gone.line = trim(x.line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))),
t AS (SELECT doc_id, any_value(text) AS old, count(*) AS lines, count(*) FILTER (NOT stays) AS lines_cut,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS text FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN old IS NULL THEN 0 ELSE lines END AS lines, CASE WHEN old IS NULL THEN 0 ELSE lines_cut END AS lines_cut,
  CASE WHEN old IS NOT NULL THEN length(text) END AS n_chars, CASE WHEN old IS NOT NULL THEN md5(text) END AS text_md5 FROM t
"""


@query("op5_line_dedup", LINES.format(sites=line_dedup.MIN_SITES))
def op5(spark, folder):
    cut = line_dedup.drop_boilerplate(table(spark, folder, "documents"), counts=True)
    return cut.select("doc_id", "lines", "lines_cut", "n_chars", F.md5("text").alias("text_md5"))


@query("op6_fingerprints")
def op6(spark, folder):
    return fingerprints.compare(table(spark, folder, "documents"))


@query("op7_quality_classifier")
def op7(spark, folder):
    kept = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return kept.withColumn("log_weight", F.round("log_weight", 6))


@query("op10_html_extraction")
def op10(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


@query("op8_sentencepiece")
def op8(spark, folder):
    return pieces.round_trip(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_search")
def op9(spark, folder):
    docs = table(spark, folder, "documents")
    return search.search(docs, docs.where("doc_id % 50 = 0"))


@query("op11_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
      + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
      + 16 * coalesce(doc_id > least, FALSE)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before
  FROM orders, range(1, 6) r(step)),
told AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told
""")
def op11(spark, folder):
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS same FROM documents),
r AS (
  SELECT doc_id, sha256(same) AS text_sha256, count(*) OVER (PARTITION BY same) AS group_size,
    first_value(doc_id) OVER best AS keep_id, row_number() OVER best = 1 AS kept
  FROM d WINDOW best AS (PARTITION BY same ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
""")
def op12(spark, folder):
    told = exact_dedup.classes(table(spark, folder, "documents"))
    return told.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op13_periodic_runs")
def op13(spark, folder):
    docs = table(spark, folder, "documents")
    found = periodic_runs.detect(docs.select("doc_id", periodic_runs.looped(F.col("text"), F.col("doc_id")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = periodic_runs.strongest(F.col("runs"))
    told = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select(
        "doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
