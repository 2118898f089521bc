"""Cleaning, split and feature queries (P, T, F)."""

from pyspark.sql import functions as F

from fraudwatch import fixed
from fraudwatch.catalog.inputs import DOC, corpus, table
from fraudwatch.catalog.registry import query
from fraudwatch.functions import labels, text
from fraudwatch.operators import cleaning, splits
from fraudwatch.plans import features

MAX_TERMS = fixed.MAX_TERMS


def rated(spark, folder):
    """Documents with their rating, which some of them lack."""
    rating = table(spark, folder, "labels").select("doc_id", F.col("toxic").cast("string").alias("label"))
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    return docs.join(rating, "doc_id", "left")


@query(
    "p1_drop_missing",
    """SELECT d.doc_id, md5(d.text) AS content_md5, CAST(l.toxic AS VARCHAR) AS label
       FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL AND d.text IS NOT NULL""",
)
def p1_drop_missing(spark, folder):
    kept = cleaning.drop_missing(rated(spark, folder), ["content", "label"])
    return kept.select("doc_id", F.md5("content").alias("content_md5"), "label")


@query(
    "p2_normalise_text",
    f"WITH {DOC} SELECT msg_key, md5(content) AS content_md5, CAST(class_id AS VARCHAR) AS label FROM doc",
)
def p2_normalise_text(spark, folder):
    raw = corpus(spark, folder).withColumn(
        "label", F.concat(F.lit("　 \n"), F.col("class_id").cast("string"), F.lit(".0\t "))
    )
    clean = cleaning.normalise_text(raw).withColumn("label", labels.canonical_label(F.col("label")))
    return clean.select("msg_key", F.md5("content").alias("content_md5"), "label")


STAGES = f"""{DOC}, st AS (SELECT msg_key, class_id, CASE WHEN class_id <> 0 THEN 1 ELSE 0 END AS stage1_label,
  class_id - 1 AS stage2_label FROM doc)"""


@query("p3_stage1", f"WITH {STAGES} SELECT msg_key, stage1_label FROM st")
def p3_stage1(spark, folder):
    return cleaning.stage_labels(corpus(spark, folder)).select("msg_key", "stage1_label")


@query("p4_stage2", f"WITH {STAGES} SELECT msg_key, stage2_label FROM st")
def p4_stage2(spark, folder):
    return cleaning.stage_labels(corpus(spark, folder)).select("msg_key", "stage2_label")


@query("p5_actual_class", f"WITH {STAGES} SELECT msg_key, class_id AS actual_class FROM st")
def p5_actual_class(spark, folder):
    staged = cleaning.stage_labels(corpus(spark, folder))
    again = labels.actual_class(F.col("stage1_label"), F.col("stage2_label"))
    return staged.select("msg_key", again.alias("actual_class"))


@query(
    "p6_fine_label",
    f"WITH {DOC} SELECT msg_key, CASE WHEN class_id = 0 THEN '正常' ELSE CAST(class_id AS VARCHAR) END AS fine_label FROM doc",
)
def p6_fine_label(spark, folder):
    label = labels.fine_label(F.col("class_id").cast("string"))
    return corpus(spark, folder).select("msg_key", label.alias("fine_label"))


@query("p7_fraud_only", f"WITH {DOC} SELECT msg_key, class_id FROM doc WHERE class_id <> 0")
def p7_fraud_only(spark, folder):
    return cleaning.fraud_only(corpus(spark, folder)).select("msg_key", "class_id")


@query(
    "p8_cost_weight",
    f"WITH {DOC} SELECT msg_key, CASE WHEN class_id = 0 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS cost_weight FROM doc",
)
def p8_cost_weight(spark, folder):
    return cleaning.weighted(corpus(spark, folder)).select("msg_key", "cost_weight")


@query(
    "p9_blank_to",
    f"""WITH {DOC} SELECT msg_key, md5(CASE WHEN lang = 'es' THEN '无内容' ELSE regexp_replace(content, '^\\s+|\\s+$', '', 'g') END)
          AS content_md5, CASE WHEN lang = 'fr' THEN '无标签' ELSE source END AS label FROM doc""",
)
def p9_blank_to(spark, folder):
    raw = corpus(spark, folder).select(
        "msg_key",
        F.when(F.col("lang") == "es", "  \n　").otherwise(F.col("content")).alias("content"),
        F.when(F.col("lang") != "fr", F.concat(F.lit(" "), F.col("source"))).alias("label"),
    )
    return cleaning.fill_blanks(raw).select("msg_key", F.md5("content").alias("content_md5"), "label")


@query(
    "p10_clean_feedback",
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE replace(replace(text, chr(10), ' '), ',', '，') END AS content,
         CASE WHEN role = 'user' THEN '正常' ELSE role END AS label, role <> 'system' AS accepted FROM conversations""",
)
def p10_clean_feedback(spark, folder):
    raw = table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") != "system", F.col("text")).alias("content"),
        F.when(F.col("role") != "user", F.col("role")).alias("label"),
    )
    accepted, rejected = cleaning.clean_feedback(raw)
    return accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))


@query("p11_preview", f"WITH {DOC} SELECT msg_key, substr(content, 1, 60) || '...' AS preview FROM doc")
def p11_preview(spark, folder):
    return corpus(spark, folder).select("msg_key", text.preview(F.col("content"), 60).alias("preview"))


@query("p12_model_inputs", f"WITH {DOC} SELECT content AS content, class_id FROM doc")
def p12_model_inputs(spark, folder):
    return cleaning.model_inputs(corpus(spark, folder), ["content", "class_id"])


RANKED = f"""{DOC}, o AS (SELECT msg_key, class_id, count(*) OVER (PARTITION BY class_id) AS n,
  row_number() OVER (PARTITION BY class_id ORDER BY msg_key) AS rn FROM doc)"""


@query(
    "t1_split_head",
    f"""WITH {RANKED} SELECT msg_key, class_id, CASE WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'test' END AS split
        FROM o""",
)
def t1_split_head(spark, folder):
    return splits.split_head(corpus(spark, folder).select("msg_key", "class_id"), "class_id", "msg_key")


TAIL = f"""{RANKED}, tail AS (SELECT msg_key, class_id, CASE WHEN rn > n - floor(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END
  AS split FROM o)"""


@query("t2_split_tail", f"WITH {TAIL} SELECT msg_key, class_id, split FROM tail")
def t2_split_tail(spark, folder):
    return splits.split_tail(corpus(spark, folder).select("msg_key", "class_id"), "class_id", "msg_key")


@query(
    "t3_split_gap",
    f"""WITH {RANKED} SELECT msg_key, class_id, CASE WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'train'
          WHEN rn > n - floor(n * 0.1::DOUBLE) THEN 'test' ELSE 'none' END AS split FROM o""",
)
def t3_split_gap(spark, folder):
    return splits.split_gap(corpus(spark, folder).select("msg_key", "class_id"), "class_id", "msg_key")


@query(
    "t4_split_stratified",
    f"""WITH {DOC}, o AS (SELECT msg_key, class_id,
            row_number() OVER (PARTITION BY class_id ORDER BY md5(msg_key || ':42'), msg_key) AS rn FROM doc),
          c AS (SELECT class_id, count(*) AS n FROM doc GROUP BY class_id),
          a AS (SELECT (SELECT sum(n) FROM c) - ceil((SELECT sum(n) FROM c) * 0.2::DOUBLE) AS tr),
          s AS (SELECT class_id, n * tr::DOUBLE / (SELECT sum(n) FROM c) AS share FROM c, a),
          w AS (SELECT class_id, floor(share) AS whole,
                  row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, class_id) AS place FROM s),
          k AS (SELECT class_id, whole + CASE WHEN place <= (SELECT tr FROM a) - (SELECT sum(whole) FROM w) THEN 1 ELSE 0 END AS k
                FROM w)
        SELECT o.msg_key, o.class_id, CASE WHEN o.rn <= k.k THEN 'train' ELSE 'test' END AS split
        FROM o JOIN k USING (class_id)""",
)
def t4_split_stratified(spark, folder):
    return splits.split_stratified(corpus(spark, folder).select("msg_key", "class_id"), "class_id", "msg_key")


@query(
    "t5_split_shuffled",
    f"""WITH {DOC}, o AS (SELECT msg_key, source, count(*) OVER (PARTITION BY source) AS n,
          row_number() OVER (PARTITION BY source ORDER BY md5(msg_key || ':42'), msg_key) AS rn FROM doc)
        SELECT msg_key, source, CASE WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM o""",
)
def t5_split_shuffled(spark, folder):
    return splits.split_shuffled(corpus(spark, folder).select("msg_key", "source"), "source", "msg_key")


@query(
    "t2_split_any_key",
    f"""WITH {DOC}, v AS (SELECT msg_key, CASE WHEN lang = 'es' THEN NULL ELSE class_id END AS grp,
            CASE WHEN source <> 'src3' THEN source END AS k FROM doc),
          r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k NULLS FIRST, msg_key) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM v)
        SELECT msg_key, CASE WHEN rn <= n - floor(n * 0.1::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def t2_split_any_key(spark, folder):
    """Text keys that repeat or are missing, and a group that is null."""
    rows = corpus(spark, folder).select(
        "msg_key", F.when(F.col("lang") != "es", F.col("class_id")).alias("grp"), F.when(F.col("source") != "src3", F.col("source")).alias("k")
    )
    return splits.split_tail(rows, "grp", "k", tie="msg_key").select("msg_key", "split")


@query("t6_split_summary", f"WITH {TAIL} SELECT class_id, split, count(*) AS n FROM tail GROUP BY class_id, split")
def t6_split_summary(spark, folder):
    return splits.split_summary(t2_split_tail(spark, folder), "class_id")


# Characters with their successors, then one row per gram occurrence.
GRAMS = r"""ch AS (SELECT msg_key, unnest(c) AS c1, unnest(range(len(c))) AS pos FROM
    (SELECT msg_key, string_split(regexp_replace(lower(content), '\s\s+', ' ', 'g'), '') AS c FROM src)),
  nx AS (SELECT msg_key, pos, c1, lead(c1, 1) OVER w AS c2, lead(c1, 2) OVER w AS c3, lead(c1, 3) OVER w AS c4 FROM ch
    WINDOW w AS (PARTITION BY msg_key ORDER BY pos)),
  occ AS (SELECT msg_key, c1 AS gram FROM nx UNION ALL SELECT msg_key, c1 || c2 FROM nx WHERE c2 IS NOT NULL
    UNION ALL SELECT msg_key, c1 || c2 || c3 FROM nx WHERE c3 IS NOT NULL),
  tf AS (SELECT msg_key, gram, count(*) AS tf FROM occ GROUP BY msg_key, gram)"""


@query("f1_char_ngrams", f"WITH {DOC}, src AS (SELECT msg_key, content FROM doc), {GRAMS} SELECT msg_key, gram, tf FROM tf")
def f1_char_ngrams(spark, folder):
    rows = features.gram_rows(corpus(spark, folder), "msg_key", "content")
    return rows.withColumn("tf", F.col("tf").cast("bigint"))


@query(
    "f2_top_terms",
    f"""WITH {DOC}, src AS (SELECT msg_key, content FROM doc), {GRAMS}
        SELECT gram, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY gram ORDER BY tf DESC, gram LIMIT {MAX_TERMS}""",
)
def f2_top_terms(spark, folder):
    return features.top_terms(corpus(spark, folder), "msg_key", "content", MAX_TERMS)


def parts(spark, folder):
    """Train and test corpus of the ordered split."""
    docs = splits.split_tail(corpus(spark, folder), "class_id", "msg_key")
    return docs.filter("split = 'train'"), docs.filter("split = 'test'")


@query(
    "f3_tfidf",
    f"""WITH {TAIL}, src AS (SELECT msg_key, content FROM doc), {GRAMS},
          fit AS (SELECT gram, sum(tf) AS tf, count(*) AS df FROM tf JOIN tail USING (msg_key) WHERE split = 'train'
            GROUP BY gram ORDER BY sum(tf) DESC, gram LIMIT {MAX_TERMS}),
          idf AS (SELECT gram, ln((1.0::DOUBLE + (SELECT count(*) FROM tail WHERE split = 'train')) / (1 + df)) + 1 AS idf FROM fit),
          raw AS (SELECT msg_key, gram, tf * idf AS raw FROM tf JOIN idf USING (gram) JOIN tail USING (msg_key) WHERE split = 'test')
        SELECT msg_key, gram, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY msg_key)), 6) AS weight FROM raw""",
)
def f3_tfidf(spark, folder):
    """Fitted on train, applied to test."""
    train, test = parts(spark, folder)
    model = features.tfidf_fit(train, "msg_key", "content", MAX_TERMS)
    return features.tfidf_long(model, test, "msg_key", "content").withColumn("weight", F.round("weight", 6))


VOCAB = f"""{TAIL}, cc AS (SELECT msg_key, unnest(string_split(content, '')) AS ch, unnest(range(length(content))) AS pos FROM doc),
  f AS (SELECT ch, msg_key, pos, row_number() OVER (PARTITION BY ch ORDER BY msg_key, pos) AS nth
    FROM cc JOIN tail USING (msg_key) WHERE split = 'train'),
  vocab AS (SELECT ch, 1 + row_number() OVER (ORDER BY msg_key, pos) AS id FROM f WHERE nth = 1)"""


@query("f4_build_vocab", f"WITH {VOCAB} SELECT ch, id FROM vocab")
def f4_build_vocab(spark, folder):
    train, _ = parts(spark, folder)
    vocab = features.build_vocab(train, "msg_key", "content")
    return vocab.withColumn("id", F.col("id").cast("bigint"))


def _codes_sql(length):
    return f"""code AS (SELECT msg_key, string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ',' ORDER BY pos) AS ids,
        count(*) AS used FROM cc LEFT JOIN vocab v USING (ch) WHERE pos < {length} GROUP BY msg_key),
      padded AS (SELECT msg_key, ids || repeat(',0', {length} - CAST(used AS INTEGER)) AS encoded, used FROM code)"""


@query("f5_encode", f"WITH {VOCAB}, {_codes_sql(fixed.CNN_LENGTH)} SELECT msg_key, encoded FROM padded")
def f5_encode(spark, folder):
    train, _ = parts(spark, folder)
    vocab = features.Vocabulary.of(features.build_vocab(train, "msg_key", "content"))
    coded = features.encode(corpus(spark, folder), vocab, "content")
    return coded.select("msg_key", F.array_join("encoded", ",").alias("encoded"))


@query(
    "f6_encode_masked",
    f"""WITH {VOCAB}, {_codes_sql(fixed.CHAT_LENGTH)} SELECT msg_key, encoded AS input_ids,
          substr(repeat(',1', CAST(used AS INTEGER)) || repeat(',0', {fixed.CHAT_LENGTH} - CAST(used AS INTEGER)), 2) AS attention_mask
        FROM padded""",
)
def f6_encode_masked(spark, folder):
    train, _ = parts(spark, folder)
    vocab = features.Vocabulary.of(features.build_vocab(train, "msg_key", "content"))
    coded = features.encode_masked(corpus(spark, folder), vocab, "content", fixed.CHAT_LENGTH)
    joined = [F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask")]
    return coded.select("msg_key", *joined)


CHAT = r"""chat AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '无内容' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS content,
  CASE WHEN role = 'assistant' THEN '无标签' ELSE role END AS label FROM conversations)"""


@query(
    "f7_to_chat",
    f"""WITH {CHAT} SELECT conv_id, turn,
          to_json([{{'role': 'user', 'content': content}}, {{'role': 'assistant', 'content': label}}])::VARCHAR AS messages,
          'user' || chr(10) || content || chr(10) || 'assistant' || chr(10) || label AS flat,
          'user' || chr(10) || content AS ask FROM chat""",
)
def f7_to_chat(spark, folder):
    raw = table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "system", " ").otherwise(F.col("text")).alias("content"),
        F.when(F.col("role") != "assistant", F.col("role")).alias("label"),
    )
    ask = features.to_chat(raw, with_answer=False).withColumnRenamed("messages", "question")
    return features.to_chat(ask).select(
        "conv_id", "turn",
        F.to_json("messages").alias("messages"),
        features.flatten_chat(F.col("messages")).alias("flat"),
        features.flatten_chat(F.col("question")).alias("ask"),
    )


@query(
    "f8_index_labels",
    f"""WITH {DOC}, l AS (SELECT source, row_number() OVER (ORDER BY min(msg_key)) - 1 AS label_id FROM doc GROUP BY source),
          asked AS (SELECT d.msg_key, l.label_id, CASE WHEN d.lang = 'es' THEN l.label_id + 10 ELSE l.label_id END AS asked_id
            FROM doc d JOIN l USING (source))
        SELECT a.msg_key, a.label_id, a.asked_id, coalesce(l.source, '未知诈骗') AS label_name
        FROM asked a LEFT JOIN l ON l.label_id = a.asked_id""",
)
def f8_index_labels(spark, folder):
    """Dictionary, then the inverse; some ids asked for are not in it."""
    docs = corpus(spark, folder).select("msg_key", "source", "lang")
    dictionary = features.index_labels(docs, "msg_key", "source")
    asked = features.apply_labels(docs, dictionary, "source").withColumn(
        "asked_id", F.when(F.col("lang") == "es", F.col("label_id") + 10).otherwise(F.col("label_id"))
    )
    named = features.name_labels(asked, dictionary, "source", "asked_id")
    return named.select(
        "msg_key", F.col("label_id").cast("bigint"), F.col("asked_id").cast("bigint"), "label_name"
    )
