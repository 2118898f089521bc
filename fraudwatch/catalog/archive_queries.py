"""Report archive, dashboard and registry queries (R, U, P13, P14)."""

from pyspark.sql import functions as F

from fraudwatch import fixed
from fraudwatch.catalog.inputs import (
    ARCHIVED_TYPE, MEMBERS, MSG, REG, REP, TODAY, choose, messages, registry, reports, scored, seconds, seconds_sql,
    slots, table,
)
from fraudwatch.catalog.registry import query
from fraudwatch.catalog.score_queries import CANONICAL_SQL
from fraudwatch.functions import labels, scores as S
from fraudwatch.operators import cleaning, ensemble, keyed, ordering, reports as R
from fraudwatch.plans import replies
from fraudwatch.session import new_path

TODAY_COLUMN = lambda: F.lit(TODAY)
STAMP = seconds_sql("ts")
TRIGGERS = """concat_ws(',', CASE WHEN p0 >= 0.85 THEN 'boosted' END, CASE WHEN p1 >= 0.85 THEN 'presence' END,
  CASE WHEN p2 >= 0.85 THEN 'semantic' END)"""


def flat(frame):
    """Reports as plain columns."""
    return frame.select(
        "id", "mailbox", "status", seconds("timestamp").alias("stamp"),
        F.array_join("detection.trigger_models", ",").alias("trigger_models"),
        F.col("data.fraud_type").alias("fraud_type"),
    )


FLAT = f"""id, mailbox, 'intercepted' AS status, {STAMP} AS stamp, {TRIGGERS} AS trigger_models, ftype AS fraud_type"""


@query("r1_build_reports", f"WITH {REP} SELECT {FLAT} FROM rep")
def r1_build_reports(spark, folder):
    return flat(reports(spark, folder))


@query("r2_archive", f"WITH {REP} SELECT {FLAT} FROM rep")
def r2_archive(spark, folder):
    """Write the archive, read it back newest first."""
    path = new_path(spark, "archive")
    R.archive(reports(spark, folder), path)
    return flat(R.read_archive(spark, path))


@query("r3_total_intercepted", f"WITH {REP} SELECT count(*) AS total_intercepted FROM rep")
def r3_total_intercepted(spark, folder):
    return R.total_intercepted(reports(spark, folder))


@query("r4_daily_counts", f"WITH {REP} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM rep GROUP BY 1")
def r4_daily_counts(spark, folder):
    return R.daily_counts(reports(spark, folder)).withColumn("day", F.col("day").cast("string"))


@query("r5_type_distribution", f"WITH {REP} SELECT coalesce(ftype, '未知诈骗') AS type, count(*) AS n FROM rep GROUP BY 1")
def r5_type_distribution(spark, folder):
    return R.type_distribution(reports(spark, folder))


@query(
    "r6_mailbox_stats",
    f"""WITH {REP}, {REG} SELECT g.email, count(r.id) AS intercept_count, strftime(max(r.ts), '%Y-%m-%d %H:%M:%S.%f') AS last_hit
        FROM reg g LEFT JOIN rep r ON r.mailbox = g.email GROUP BY g.email""",
)
def r6_mailbox_stats(spark, folder):
    stats = R.mailbox_stats(reports(spark, folder), registry(spark, folder))
    return stats.withColumn("last_hit", seconds("last_hit"))


@query("r7_mailbox_count", f"WITH {REG} SELECT count(*) AS mailbox_count FROM reg")
def r7_mailbox_count(spark, folder):
    return R.mailbox_count(registry(spark, folder))


@query(
    "r8_stats_bundle",
    f"""WITH {REP}, {REG}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS key, count(*) AS n FROM rep GROUP BY 1),
          t AS (SELECT coalesce(ftype, '未知诈骗') AS key, count(*) AS n FROM rep GROUP BY 1)
        SELECT (SELECT count(*) FROM rep) AS total_intercepted, (SELECT count(*) FROM reg) AS mailbox_count,
          (SELECT string_agg(key || '=' || n, ';' ORDER BY key) FROM d) AS daily_counts,
          (SELECT string_agg(key || '=' || n, ';' ORDER BY key) FROM t) AS type_distribution""",
)
def r8_stats_bundle(spark, folder):
    entries = lambda name: F.array_join(
        F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";"
    ).alias(name)
    bundle = R.stats_bundle(reports(spark, folder), registry(spark, folder))
    return bundle.select("total_intercepted", "mailbox_count", entries("daily_counts"), entries("type_distribution"))


@query("r9_today_count", f"WITH {REP} SELECT count(*) AS today_count FROM rep WHERE CAST(ts AS DATE) = DATE '{TODAY}'")
def r9_today_count(spark, folder):
    return R.today_count(reports(spark, folder), TODAY_COLUMN())


@query(
    "r10_top_type",
    f"""WITH {REP}, c AS (SELECT coalesce(ftype, '未知诈骗') AS type, count(*) AS n FROM rep GROUP BY 1)
        SELECT type, n, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM c), 1) AS share FROM c ORDER BY n DESC, type LIMIT 1""",
)
def r10_top_type(spark, folder):
    return R.top_type(reports(spark, folder))


@query(
    "r11_trend",
    f"""WITH {REP}, cal AS (SELECT DATE '{TODAY}' - CAST(unnest(range(7)) AS INTEGER) AS day)
        SELECT strftime(c.day, '%Y-%m-%d') AS day, strftime(c.day, '%m-%d') AS label, count(r.id) AS n
        FROM cal c LEFT JOIN rep r ON CAST(r.ts AS DATE) = c.day GROUP BY c.day""",
)
def r11_trend(spark, folder):
    return R.trend(reports(spark, folder), TODAY_COLUMN()).withColumn("day", F.col("day").cast("string"))


@query("r12_recent", f"WITH {REP} SELECT {FLAT} FROM rep ORDER BY ts DESC, id LIMIT 5")
def r12_recent(spark, folder):
    return flat(R.recent(reports(spark, folder)))


@query(
    "r13_sort_by_time",
    f"WITH {REP} SELECT id, {STAMP} AS stamp, row_number() OVER (ORDER BY ts DESC, id) AS rank FROM rep",
)
def r13_sort_by_time(spark, folder):
    """The rank makes the order visible to a check that ignores row order."""
    slim = reports(spark, folder).select("id", "timestamp")
    return ordering.global_rank(slim, R.newest_first()).select("id", seconds("timestamp").alias("stamp"), "rank")


@query(
    "r14_sort_by_category",
    f"""WITH {REP} SELECT id, coalesce(nullif(ftype, ''), '疑似诈骗') AS category,
          row_number() OVER (ORDER BY coalesce(nullif(ftype, ''), '疑似诈骗'), ts DESC, id) AS rank FROM rep""",
)
def r14_sort_by_category(spark, folder):
    slim = reports(spark, folder).select("id", "timestamp", F.struct("data.fraud_type").alias("data"))
    ranked = ordering.global_rank(slim, R.category_order())
    return ranked.select("id", labels.shown_type(R.fraud_type()).alias("category"), "rank")


@query(
    "r15_type_distribution_full",
    f"""WITH {REP}, c AS (SELECT {CANONICAL_SQL} AS type FROM (SELECT ftype AS t FROM rep))
        SELECT k.type, (SELECT count(*) FROM c WHERE c.type = k.type) AS n
        FROM (SELECT unnest(['公检法诈骗', '贷款诈骗', '客服诈骗', '熟人诈骗']) AS type) k""",
)
def r15_type_distribution_full(spark, folder):
    return R.type_distribution_full(reports(spark, folder))


def detected_mail(spark, folder):
    """Detected messages with mail fields; probabilities keep four places."""
    rounded = F.array(*[s.withField("prob", F.round(s["prob"], 4)) for s in slots()])
    return ensemble.detect(scored(spark, folder).withColumn("scores", rounded), len(MEMBERS)).withColumns(
        {"from": F.concat("event_type", F.lit("@sender.example")), "subject": F.col("event_type"),
         "body": F.col("props"), "date": F.date_format("sent_at", "yyyy-MM-dd")}
    )


ROUNDED = f"""{MSG}, r AS (SELECT * REPLACE (round(p0, 4) AS p0, round(p1, 4) AS p1, round(p2, 4) AS p2) FROM msg),
  hit AS (SELECT *, {TRIGGERS} AS triggers FROM r WHERE p0 >= 0.85 OR coalesce(p1 >= 0.85, FALSE) OR p2 >= 0.85)"""


def _prompt_sql():
    pieces = [p.replace("'", "''") for p in fixed.PROMPT_FORMAT.split("%s")]
    nl = "chr(10)"
    member = lambda name, prob, kind: (
        f"'    \"{name}\": {{' || {nl} || '      \"prob\": ' || {prob} || ',' || {nl} || "
        f"'      \"type\": \"' || {kind} || '\"' || {nl} || '    }}'"
    )
    presence = member("presence", "p1", "tname || ' (' || class_id || ')'")
    detail = f"""concat_ws(',' || {nl}, {member('boosted', 'p0', 'tname')},
        CASE WHEN p1 IS NOT NULL THEN {presence} END, {member('semantic', 'p2', 'tname')})"""
    models = f"""concat_ws(',' || {nl}, CASE WHEN p0 >= 0.85 THEN '    "boosted"' END,
        CASE WHEN p1 >= 0.85 THEN '    "presence"' END, CASE WHEN p2 >= 0.85 THEN '    "semantic"' END)"""
    detection = f"""('{{' || {nl} || '  "is_fraud": true,' || {nl} || '  "trigger_models": [' || {nl} || {models} ||
        {nl} || '  ],' || {nl} || '  "details": {{' || {nl} || {detail} || {nl} || '  }}' || {nl} || '}}')"""
    slots = ["mailbox", "event_type || '@sender.example'", "event_type", "props",
             "strftime(ts, '%Y-%m-%d %H:%M:%S')", detection, "strftime(ts, '%Y-%m-%d')"]
    out = [f"'{pieces[0]}'"]
    for slot, piece in zip(slots, pieces[1:]):
        out += [slot, f"'{piece}'"]
    return " || ".join(out)


@query("r16_build_prompts", f"WITH {ROUNDED}, p AS (SELECT msg_key, {_prompt_sql()} AS prompt FROM hit) "
       "SELECT msg_key, md5(prompt) AS prompt_md5, length(prompt) AS prompt_length FROM p")
def r16_build_prompts(spark, folder):
    prompts = replies.build_prompts(detected_mail(spark, folder), F.col("sent_at"))
    return prompts.select(
        "msg_key", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_length")
    )


def generated_replies(spark, folder):
    """A reply per message: whole, without JSON, with broken JSON, without markers, or none."""
    body = F.concat(
        F.lit('{"fraud_type": "'), labels.class_name(F.col("class_id")), F.lit('", "confidence_avg": '),
        F.col("k").cast("string"), F.lit("}"),
    )
    fence = lambda inside: F.concat(F.lit("\n```json\n"), inside, F.lit("\n```\n"))
    alert = F.concat(F.lit("开头\n" + fixed.ALERT_MARKER + "\n 您好 "), F.col("props"), F.lit(" \n"))
    reply = (
        F.when(F.col("event_type") == "click", F.concat(alert, F.lit(fixed.ARCHIVE_MARKER), fence(body), F.lit("结束")))
        .when(F.col("event_type") == "purchase", F.concat(alert, F.lit(fixed.ARCHIVE_MARKER)))
        .when(F.col("event_type") == "view", F.concat(alert, F.lit(fixed.ARCHIVE_MARKER), fence(F.lit("{'fraud_type': "))))
        .when(F.col("event_type") == "signup", fence(body))
    )
    return messages(spark, folder).withColumn("reply", reply)


@query(
    "r17_parse_responses",
    f"""WITH {MSG} SELECT msg_key,
          CASE event_type WHEN 'click' THEN '您好 ' || props WHEN 'purchase' THEN '您好 ' || props WHEN 'signup' THEN ''
            ELSE '{fixed.REPLY_UNAVAILABLE}' END AS alert,
          CASE WHEN event_type IN ('click', 'signup') THEN tname END AS fraud_type,
          CASE WHEN event_type IN ('click', 'signup') THEN CAST(k AS VARCHAR) END AS confidence_avg,
          CASE WHEN event_type = 'purchase' THEN '开头' || chr(10) || '{fixed.ALERT_MARKER}' || chr(10) || ' 您好 ' || props
            || ' ' || chr(10) || '{fixed.ARCHIVE_MARKER}' END AS content,
          CASE WHEN event_type IN ('view', 'error') THEN 'invalid json' END AS error
        FROM msg""",
)
def r17_parse_responses(spark, folder):
    parsed = replies.parse_responses(generated_replies(spark, folder), "reply")
    return parsed.select("msg_key", "alert", "data.fraud_type", "data.confidence_avg", "data.content", "data.error")


@query(
    "r18_template_report",
    f"""WITH {ROUNDED}, f AS (SELECT *, CASE split_part(triggers, ',', 1) WHEN 'presence' THEN tname || ' (' || class_id || ')'
            ELSE tname END AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
            (p0 + coalesce(p1, 0) + p2) / (2 + CAST(p1 IS NOT NULL AS INTEGER)) AS conf FROM hit),
          g AS (SELECT *, {CANONICAL_SQL} AS kind FROM f)
        SELECT msg_key, stamp AS intercept_time, mailbox AS user_mailbox, substr(props, 1, 60) || '...' AS raw_content_summary,
          kind AS fraud_type, printf('%.6f', conf) AS confidence_avg,
          stamp || ' ' || kind || '：{fixed.REPLY_UNAVAILABLE}' AS user_alert_content,
          '{fixed.DEFAULT_ADVICE}' AS similar_cases_suggest FROM g""",
)
def r18_template_report(spark, folder):
    detected = detected_mail(spark, folder)
    confidence = S.mean_confidence(slots())
    filled = replies.template_report(detected, F.col("sent_at"), confidence)
    return filled.select("msg_key", *[f"data.{name}" for name in fixed.ARCHIVE_FIELDS])


@query("r19_new_counts", f"WITH {MSG} SELECT mailbox, count(*) AS new_count FROM msg GROUP BY mailbox")
def r19_new_counts(spark, folder):
    return R.new_counts(messages(spark, folder))


@query(
    "u1_concat",
    """SELECT conv_id AS key, text AS content, role, NULL AS lang FROM conversations
       UNION ALL SELECT item_id, text, NULL, NULL FROM benchmark
       UNION ALL SELECT doc_id, md5(text), NULL, lang FROM documents""",
)
def u1_concat(spark, folder):
    return keyed.concat(
        table(spark, folder, "conversations").selectExpr("conv_id AS key", "text AS content", "role"),
        table(spark, folder, "benchmark").selectExpr("item_id AS key", "text AS content"),
        table(spark, folder, "documents").selectExpr("doc_id AS key", "md5(text) AS content", "lang"),
    )


@query(
    "u2_remove_mailbox",
    f"""WITH {MSG}, {REG}, gone AS (SELECT DISTINCT mailbox FROM msg WHERE event_type = 'signup')
        SELECT email, 'kept' AS outcome, 1 AS n FROM reg WHERE email NOT IN (SELECT mailbox FROM gone)
        UNION ALL SELECT '', 'removed', count(*) FROM reg WHERE email IN (SELECT mailbox FROM gone)""",
)
def u2_remove_mailbox(spark, folder):
    keys = messages(spark, folder).filter("event_type = 'signup'").select(F.col("mailbox").alias("email"))
    kept, removed = keyed.remove_mailbox(registry(spark, folder), keys)
    return kept.select("email", F.lit("kept").alias("outcome"), F.lit(1).cast("bigint").alias("n")).unionByName(
        removed.select(F.lit("").alias("email"), F.lit("removed").alias("outcome"), F.col("removed").alias("n"))
    )


@query(
    "u3_add_mailboxes",
    f"""WITH {MSG}, known AS (SELECT 'user' || s_suppkey || '@example.com' AS email FROM supplier),
          b AS (SELECT msg_key, CASE WHEN event_type = 'error' THEN ' ' ELSE mailbox END AS email FROM msg),
          r AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY msg_key) AS rn FROM b)
        SELECT CASE WHEN email = ' ' THEN msg_key WHEN rn = 1 AND email NOT IN (SELECT email FROM known) THEN NULL
                 ELSE msg_key END AS msg_key, email,
          CASE WHEN email = ' ' THEN 'blank' WHEN rn = 1 AND email NOT IN (SELECT email FROM known) THEN 'added'
               ELSE 'exists' END AS outcome FROM r""",
)
def u3_add_mailboxes(spark, folder):
    known = table(spark, folder, "supplier").select(
        F.concat(F.lit("user"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email")
    )
    batch = messages(spark, folder).select(
        "msg_key", F.when(F.col("event_type") == "error", " ").otherwise(F.col("mailbox")).alias("email")
    )
    added, rejected = keyed.add_mailboxes(known, batch, "msg_key", F.to_timestamp(TODAY_COLUMN()))
    return rejected.select("msg_key", "email", F.col("reason").alias("outcome")).unionByName(
        added.select(F.lit(None).cast("bigint").alias("msg_key"), "email", F.lit("added").alias("outcome"))
    )


@query(
    "u4_update_mailbox",
    f"""WITH {REP}, {REG} SELECT g.email, g.intercept_count + count(r.id) AS intercept_count,
          strftime(max(r.ts), '%Y-%m-%d %H:%M:%S.%f') AS last_checked
        FROM reg g LEFT JOIN rep r ON r.mailbox = g.email GROUP BY g.email, g.intercept_count""",
)
def u4_update_mailbox(spark, folder):
    hits = reports(spark, folder).select("mailbox", F.col("timestamp").alias("at"))
    updated = keyed.update_mailbox(registry(spark, folder), hits)
    return updated.select("email", "intercept_count", seconds("last_checked").alias("last_checked"))


@query("u5_get_by_id", "SELECT event_id, event_type, props FROM events WHERE event_id = 77")
def u5_get_by_id(spark, folder):
    return keyed.get_by_id(table(spark, folder, "events"), "event_id", 77).select("event_id", "event_type", "props")


@query(
    "p13_mail_summary",
    """SELECT 'box@example.com' AS mailbox, CAST(page_id AS VARCHAR) AS uid, url AS subject, 'web' AS "from",
       length(html) AS content_len FROM pages""",
)
def p13_mail_summary(spark, folder):
    mails = table(spark, folder, "pages").select(
        F.lit("box@example.com").alias("mailbox"), F.col("page_id").cast("string").alias("uid"),
        F.col("url").alias("subject"), F.lit("web").alias("from"), F.col("html").alias("body"),
    )
    return cleaning.mail_summary(mails).withColumn("content_len", F.col("content_len").cast("bigint"))


@query(
    "p14_type_or",
    f"""WITH {MSG}, t AS (SELECT msg_key, CASE WHEN event_type = 'view' THEN '' ELSE ftype END AS t FROM msg)
        SELECT msg_key, coalesce(t, '未知诈骗') AS counted, coalesce(nullif(t, ''), '疑似诈骗') AS shown FROM t""",
)
def p14_type_or(spark, folder):
    kind = F.when(F.col("event_type") == "view", "").otherwise(choose("event_type", ARCHIVED_TYPE))
    return messages(spark, folder).select(
        "msg_key", labels.counted_type(kind).alias("counted"), labels.shown_type(kind).alias("shown")
    )
