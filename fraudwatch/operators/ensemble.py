"""OR-vote ensemble over member scores.

Wide form: one ``scores`` array per message, from ``score_all``; everything
after it is row-local.  Long form: rows ``(msg_key, ord, model, prob, type,
error)`` for scores that arrive from separate jobs; those are grouped first.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fraudwatch import fixed
from fraudwatch.functions import scores as S

Member = tuple[str, Callable[[], tuple[Column, Column, Column | None]]]


def score_all(messages: DataFrame, members: list[Member], enabled: list[str] | None = None) -> DataFrame:
    """Add ``scores``: every enabled member's probability and type, in order.

    A member is a name and a function that returns probability, type and error
    columns.  Both numbers are kept even below the threshold.
    """
    chosen = [m for m in members if enabled is None or m[0] in enabled]
    columns = [S.score(i, name, *make()) for i, (name, make) in enumerate(chosen)]
    return messages.withColumn("scores", F.array(*columns))


def to_long(scored: DataFrame, key: str) -> DataFrame:
    # There is at least one member; the plain form would test the array size per row.
    return scored.select(key, F.inline_outer("scores"))


def from_long(messages: DataFrame, long_scores: DataFrame, key: str, members: list[str]) -> DataFrame:
    """Gather separately stored scores into one array, a place per member.

    A message nobody scored keeps empty places.  Of several scores by one member
    the greatest counts, whatever order they arrive in.
    """
    fields = F.struct("ord", "model", "prob", "type", "error")
    places = [F.max(F.when(F.col("model") == name, fields)).alias(name) for name in members]
    gathered = long_scores.groupBy(key).agg(*places)
    return messages.join(gathered, key, "left").withColumn("scores", F.array(*members)).drop(*members)


def vote(long_scores: DataFrame, key: str, threshold: float = fixed.FRAUD_THRESHOLD) -> DataFrame:
    """One row per message; a member that failed does not vote."""
    voted = S.reaches(F.col("prob"), threshold) & F.col("error").isNull()
    return long_scores.groupBy(key).agg(F.bool_or(voted).alias("is_fraud"))


def detect(scored: DataFrame, members: int, threshold: float = fixed.FRAUD_THRESHOLD) -> DataFrame:
    """Add ``detection``, the verdict over the scores of ``members`` members."""
    return scored.withColumn("detection", S.verdict(S.slots(F.col("scores"), members), threshold))


def top_model(reports: DataFrame) -> DataFrame:
    # Unpacked by a generator, the pair is computed once per report.
    return reports.select("id", "mailbox", F.inline_outer(F.array(S.strongest(F.col("detection.details")))))


def score_flags(reports: DataFrame, threshold: float = fixed.FRAUD_THRESHOLD) -> DataFrame:
    """One row per report and member, flagged only strictly above the threshold."""
    return reports.select("id", F.explode_outer("detection.details").alias("model", "detail")).select(
        "id",
        "model",
        F.col("detail.prob").alias("prob"),
        S.reaches(F.col("detail.prob"), threshold, inclusive=False).alias("high"),
    ).filter(F.col("model").isNotNull())
