"""The driver's tables seen as messages, reports, mailboxes and a corpus.

``value / (value + 5)`` and its kin are stand-ins for a classifier's probability,
not models: plain algebra that two engines compute alike.  Each Spark view has
its SQL counterpart below it.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fraudwatch import fixed, schemas
from fraudwatch.functions import scores as S
from fraudwatch.operators import ensemble, reports as R

TODAY = "2024-01-30"
CLASS_OF_EVENT = {"error": 0, "click": 1, "purchase": 2, "view": 3, "signup": 4}
CLASS_OF_LANG = {"en": 0, "fr": 1, "de": 2, "es": 3}
ARCHIVED_TYPE = {
    "click": "冒充公检法及政府机关类",
    "purchase": "贷款诈骗",
    "view": "客服诈骗",
    "signup": "熟人诈骗（代购转账骗局）",
}
FAILURE = "no score"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def choose(column: str, choices: dict, default=None) -> Column:
    out = F
    for key, value in choices.items():
        out = out.when(F.col(column) == key, F.lit(value))
    return out.otherwise(F.lit(default))


def choose_sql(column: str, choices: dict, default: str = "NULL") -> str:
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN '{k}' THEN {literal(v)}" for k, v in choices.items())
    return f"CASE {column} {arms} ELSE {default} END"


TYPE_OF_EVENT = {event: fixed.CLASS_NAMES[number] for event, number in CLASS_OF_EVENT.items()}


def as_messages(events: DataFrame) -> DataFrame:
    """Works on a table and on a stream alike."""
    return events.select(
        F.col("event_id").alias("msg_key"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("mailbox"),
        F.col("ts").cast("timestamp").alias("sent_at"),
        "event_type",
        "value",
        "props",
        choose("event_type", CLASS_OF_EVENT).cast("int").alias("class_id"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
    )


def messages(spark, folder) -> DataFrame:
    return as_messages(table(spark, folder, "events"))


MSG = f"""msg AS (
  SELECT event_id AS msg_key, 'user' || user_id || '@example.com' AS mailbox, ts, event_type, value, props,
    {choose_sql('event_type', CLASS_OF_EVENT)} AS class_id,
    CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
    {choose_sql('event_type', TYPE_OF_EVENT)} AS tname,
    {choose_sql('event_type', ARCHIVED_TYPE)} AS ftype,
    value / (value + 5) AS p0,
    CASE WHEN event_type = 'error' THEN NULL
         ELSE CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 100 END AS p1,
    value / (value + 20) AS p2
  FROM events)"""


PRED_SQL = f"""{MSG}, pred AS (
  SELECT *, props AS content, CASE WHEN p0 >= 0.85 THEN k // 25 + 1 ELSE 0 END AS predicted FROM msg)"""


MEMBERS = ["boosted", "presence", "semantic"]


def slots() -> list[Column]:
    return S.slots(F.col("scores"), len(MEMBERS))


def members() -> list[ensemble.Member]:
    kind = choose("event_type", TYPE_OF_EVENT)
    value = F.col("value")
    failed = F.when(F.col("event_type") == "error", F.lit(FAILURE))
    numbered = F.concat(kind, F.lit(" ("), F.col("class_id").cast("string"), F.lit(")"))
    return [
        (MEMBERS[0], lambda: (value / (value + 5), kind, None)),
        (MEMBERS[1], lambda: (F.col("k") / F.lit(100.0), numbered, failed)),
        (MEMBERS[2], lambda: (value / (value + 20), kind, None)),
    ]


def scored(spark, folder, enabled=None) -> DataFrame:
    return ensemble.score_all(messages(spark, folder), members(), enabled)


SCORE = f"""{MSG}, score AS (
  SELECT msg_key, 0 AS ord, 'boosted' AS model, p0 AS prob, tname AS type, NULL AS error FROM msg
  UNION ALL
  SELECT msg_key, 1, 'presence', p1, CASE WHEN p1 IS NOT NULL THEN tname || ' (' || class_id || ')' END,
    CASE WHEN p1 IS NULL THEN '{FAILURE}' END FROM msg
  UNION ALL
  SELECT msg_key, 2, 'semantic', p2, tname, NULL FROM msg)"""


def archive_data() -> Column:
    """Archive record of a report: only the free-text type is known."""
    empty = F.lit(None).cast("string")
    known = {"fraud_type": choose("event_type", ARCHIVED_TYPE)}
    return F.struct(*[known.get(f.name, empty).alias(f.name) for f in schemas.ARCHIVE.fields])


def as_reports(scored_messages: DataFrame) -> DataFrame:
    detected = ensemble.detect(scored_messages, len(MEMBERS))
    return R.build_reports(detected, "msg_key", F.col("sent_at"), archive_data())


def reports(spark, folder) -> DataFrame:
    return as_reports(scored(spark, folder))


REP = f"""{MSG}, rep AS (
  SELECT sha256(length(mailbox) || ':' || mailbox || length(CAST(msg_key AS VARCHAR)) || ':' || msg_key) AS id, * FROM msg
  WHERE p0 >= 0.85 OR coalesce(p1 >= 0.85, FALSE) OR p2 >= 0.85)"""


def registry(spark, folder) -> DataFrame:
    """Customers as watched mailboxes, with a counter to start from."""
    return table(spark, folder, "customer").select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("timestamp").alias("added_at"),
        F.lit(None).cast("timestamp").alias("last_checked"),
        F.lit("active").alias("status"),
        F.col("c_nationkey").cast("bigint").alias("intercept_count"),
    )


REG = """reg AS (SELECT 'user' || c_custkey || '@example.com' AS email, c_nationkey AS intercept_count
  FROM customer)"""


def corpus(spark, folder) -> DataFrame:
    return as_corpus(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))


def as_corpus(documents: DataFrame) -> DataFrame:
    """Works on a table and on a stream alike."""
    return documents.select(
        F.col("doc_id").alias("msg_key"),
        F.col("text").alias("content"),
        choose("lang", CLASS_OF_LANG, 4).cast("int").alias("class_id"),
        "lang",
        "source",
    )


DOC = f"""doc AS (
  SELECT doc_id AS msg_key, text AS content, {choose_sql('lang', CLASS_OF_LANG, '4')} AS class_id, lang, source
  FROM documents)"""


def seconds(column) -> Column:
    """Timestamps leave the queries as text, which no engine shifts."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def seconds_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
