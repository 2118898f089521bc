"""Source and sink queries (S): write, read back, compare with the table."""

import math

from pyspark.sql import functions as F

from fraudwatch import schemas
from fraudwatch.catalog.inputs import DOC, PRED_SQL, REG, TODAY, corpus, registry, seconds, table
from fraudwatch.catalog.registry import query
from fraudwatch.catalog.score_queries import predicted
from fraudwatch.functions import labels
from fraudwatch.operators import cleaning, keyed
from fraudwatch.operators.ordering import global_rank
from fraudwatch.session import new_path
from fraudwatch.sources import corpus as C, mail, store, versions

#: Bytes of text, about, that one task writes to a file.
FILE_BYTES = 256 << 20
KEEP = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "header": True}


def _labelled(spark, folder):
    return corpus(spark, folder).select("content", F.col("class_id").cast("string").alias("label"), "class_id")


@query(
    "s1_load_corpus",
    f"WITH {DOC} SELECT class_id, CAST(class_id AS VARCHAR) AS label, md5(content) AS content_md5 FROM doc",
)
def s1_load_corpus(spark, folder):
    """One folder of CSV part files per class; the path of class 4 does not exist."""
    root = new_path(spark, "corpus")
    rows = _labelled(spark, folder)
    rows.withColumn("part", F.col("class_id")).write.partitionBy("part").options(**KEEP).csv(root)
    paths = {f"{root}/part={number}": number for number in range(5)}
    loaded = C.load_corpus(spark, paths)
    return loaded.select("class_id", "label", F.md5("content").alias("content_md5"))


@query(
    "s2_route_encodings",
    f"WITH {DOC} SELECT CAST(class_id AS VARCHAR) AS label, md5(content) AS content_md5 FROM doc",
)
def s2_route_encodings(spark, folder):
    """One folder whose files are UTF-8 or GB18030."""
    root = new_path(spark, "encodings")
    rows = _labelled(spark, folder)
    write = lambda part, encoding: (
        part.select("content", "label").write.mode("append").options(**KEEP, encoding=encoding).csv(root)
    )
    write(rows.filter("class_id < 2"), C.UTF8)
    setting = "spark.sql.legacy.javaCharsets"  # only to write such files; reading needs none
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        write(rows.filter("class_id >= 2"), C.GB18030)
    finally:
        spark.conf.set(setting, before)
    return C.read_any_encoding(spark, root).select("label", F.md5("content").alias("content_md5"))


@query(
    "s1_one_quoted_file",
    f"""WITH {DOC}, o AS (SELECT row_number() OVER (ORDER BY msg_key) AS place, msg_key,
          chr(10) || content || chr(13) || chr(10) || '"' || msg_key || '", ' || chr(10) AS content FROM doc)
        SELECT place, md5(content) AS content_md5, CAST(msg_key AS VARCHAR) AS label FROM o""",
)
def s1_one_quoted_file(spark, folder):
    """A CSV file, every text with line breaks, quotes and commas, read by many tasks in the order of the file.

    A corpus beyond FILE_BYTES is several such files, in order of their names.
    """
    root = new_path(spark, "quoted")
    rows = corpus(spark, folder)
    size = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    text = F.concat(F.lit("\n"), "content", F.lit('\r\n"'), F.col("msg_key").cast("string"), F.lit('", \n'))
    dealt = rows.repartitionByRange(max(1, math.ceil(size / FILE_BYTES)), "msg_key").sortWithinPartitions("msg_key")
    told = dealt.select(text.alias("content"), F.col("msg_key").cast("string").alias("label"))
    told.write.options(**KEEP, quoteAll=True).csv(root)
    loaded = C.load_corpus(spark, {root: 1})
    return global_rank(loaded, [F.asc("msg_key")], "place").select("place", F.md5("content").alias("content_md5"), "label")


@query(
    "s3_load_dir",
    f"""WITH {DOC} SELECT md5(content) AS content_md5, CASE class_id WHEN 1 THEN '' ELSE lang END AS label FROM doc WHERE class_id <> 2""",
)
def s3_load_dir(spark, folder):
    """Whole texts, with their line breaks, commas and quotes, in files of one, two or three fields; the last kind is skipped."""
    root = new_path(spark, "folder")
    rows = corpus(spark, folder).select("class_id", "content", "lang", F.lit("more").alias("more"))
    fields = {1: ["content"], 2: ["content", "lang", "more"]}
    for kind in (0, 1, 2):
        some = rows.filter(F.col("class_id") == kind) if kind in fields else rows.filter(~F.col("class_id").isin(*fields))
        some.select(*fields.get(kind, ["content", "lang"])).write.mode("append").options(**KEEP).csv(root)
    return C.load_dir(spark, root).select(F.md5("content").alias("content_md5"), "label")


def raw_mails(spark, folder):
    return as_raw_mails(corpus(spark, folder))


def as_raw_mails(documents):
    """Documents as base64 mails: single part, HTML then plain, HTML only, or attachment only."""
    body = F.base64(F.encode("content", "UTF-8"))
    coded = lambda kind, extra="": F.concat(
        F.lit(f"Content-Type: {kind}; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n{extra}\r\n"), body, F.lit("\r\n")
    )
    html = F.lit("Content-Type: text/html; charset=utf-8\r\n\r\n<p>x</p>\r\n")
    cut, end = F.lit("--cut\r\n"), F.lit("--cut--\r\n")
    multi = F.lit('Content-Type: multipart/mixed; boundary="cut"\r\n\r\n')
    layout = (
        F.when(F.col("class_id") == 0, coded("text/plain"))
        .when(F.col("class_id") == 1, F.concat(multi, cut, html, cut, coded("text/plain"), end))
        .when(F.col("class_id") == 2, F.concat(multi, cut, coded("text/html"), end))
        .otherwise(F.concat(multi, cut, coded("text/plain", "Content-Disposition: attachment\r\n"), end))
    )
    subject = F.concat(F.lit("=?utf-8?b?"), F.base64(F.encode(F.concat(F.lit("贷款"), F.col("source")), "UTF-8")), F.lit("?="))
    head = F.concat(F.lit("From: "), F.col("lang"), F.lit("@example.com\r\nSubject: "), subject,
                    F.lit("\r\nX-Id: "), F.col("msg_key").cast("string"),
                    F.lit("\r\nDate: Tue, 30 Jan 2024 08:00:00 +0000\r\nMIME-Version: 1.0\r\n"))
    return documents.select(
        F.col("msg_key").cast("string").alias("uid"),
        F.lit("box@example.com").alias("mailbox"),
        F.encode(F.concat(head, layout), "UTF-8").alias("raw"),
    )


@query(
    "s4_parse_mail",
    f"""WITH {DOC} SELECT CAST(msg_key AS VARCHAR) AS uid, 'box@example.com' AS mailbox, lang || '@example.com' AS "from",
          '贷款' || source AS subject, md5(CASE WHEN class_id = 3 THEN '' ELSE content END) AS body_md5,
          'Tue, 30 Jan 2024 08:00:00 +0000' AS date, CAST(NULL AS VARCHAR) AS error FROM doc""",
)
def s4_parse_mail(spark, folder):
    parsed = mail.parse_mail(raw_mails(spark, folder))
    return parsed.withColumn("body_md5", F.md5("body")).drop("body")


@query("s5_read_store", f"WITH {REG} SELECT email, 'active' AS status, intercept_count FROM reg")
def s5_read_store(spark, folder):
    """A JSON store that exists beside one that does not."""
    path = new_path(spark, "registry")
    registry(spark, folder).write.json(path)
    there = store.read_store(spark, path, schemas.MAILBOX, multi_line=False)
    absent = store.read_store(spark, path + "-absent", schemas.MAILBOX)
    return keyed.concat(there, absent).select("email", "status", "intercept_count")


@query("s6_write_store", f"WITH {REG} SELECT email, intercept_count FROM reg")
def s6_write_store(spark, folder):
    """Written twice: the second write replaces the first."""
    path = new_path(spark, "store")
    for _ in range(2):
        store.write_store(registry(spark, folder), path)
    return spark.read.parquet(path).select("email", "intercept_count")


@query(
    "s6_registry_versions",
    f"WITH {REG} SELECT email, intercept_count + 1 + (intercept_count % 2) AS intercept_count, 3::BIGINT AS version, TRUE AS refused FROM reg",
)
def s6_registry_versions(spark, folder):
    """Two edits of one version of the registry: the second is refused and made anew on what the first left."""
    path, kind = new_path(spark, "versions"), schemas.MAILBOX
    versions.commit_version(registry(spark, folder).select(*kind.names), path, 0)
    version, rows = versions.read_version(spark, path, kind)
    count = F.col("intercept_count")
    odd = lambda now: now.withColumn("intercept_count", count + F.when(count % 2 == 1, 1).otherwise(0))
    every = lambda now: now.withColumn("intercept_count", count + 1)
    versions.commit_version(odd(rows), path, version)
    try:
        versions.commit_version(every(rows), path, version)
        refused = False
    except versions.Conflict:
        refused = True
    number = versions.edit_store(spark, path, kind, every)
    done = versions.read_version(spark, path, kind)[1]
    return done.select("email", "intercept_count", F.lit(number).cast("bigint").alias("version"), F.lit(refused).alias("refused"))


@query(
    "s7_append_feedback",
    """SELECT replace(replace(text, chr(10), ' '), ',', '，') AS content, role AS label, '2024-01-30 00:00:00.000000' AS stamp
       FROM conversations""",
)
def s7_append_feedback(spark, folder):
    """User turns first, all other turns in a second append."""
    path = new_path(spark, "feedback")
    rows = table(spark, folder, "conversations").selectExpr("text AS content", "role AS label")
    accepted, _ = cleaning.clean_feedback(rows.withColumn("timestamp", F.to_timestamp(F.lit(TODAY))))
    store.append_feedback(accepted.filter("label = 'user'"), path)
    store.append_feedback(accepted.filter("label <> 'user'"), path)
    return store.read_feedback(spark, path).select("content", "label", seconds("timestamp").alias("stamp"))


@query(
    "s8_write_predictions",
    f"""WITH {PRED_SQL} SELECT content, CASE WHEN class_id = 0 THEN '正常' ELSE CAST(class_id AS VARCHAR) END AS fine_label,
          [{", ".join(repr(n) for n in ['正常', '公检法诈骗', '贷款诈骗', '客服诈骗', '熟人诈骗'])}][predicted + 1] AS predicted_label,
          round(p0, 6) AS stage1_fraud_prob FROM pred""",
)
def s8_write_predictions(spark, folder):
    path = new_path(spark, "predictions")
    rows = predicted(spark, folder).select(
        "content",
        labels.fine_label(F.col("class_id").cast("string")).alias("fine_label"),
        labels.class_name(F.col("predicted")).alias("predicted_label"),
        F.round("prob", 6).alias("stage1_fraud_prob"),
    )
    store.write_predictions(rows, path)
    return store.read_predictions(spark, path)
