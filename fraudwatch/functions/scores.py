"""Column expressions over ``array<struct<ord, model, prob, type, error>>``.

A message carries its few member scores in one array, so voting, triggers and
details are row-local: the detection path needs no shuffle.
"""

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

from fraudwatch import fixed
from fraudwatch.functions.text import bind, quoted


def reaches(prob: Column, threshold: float = fixed.FRAUD_THRESHOLD, inclusive: bool = True) -> Column:
    """Threshold test that is false for NaN and null."""
    over = prob >= F.lit(threshold) if inclusive else prob > F.lit(threshold)
    return F.coalesce(over & ~F.isnan(prob), F.lit(False))


def score(order: int, model: str, prob: Column, scam_type: Column, error: Column | None = None) -> Column:
    """One member's result; a failed member keeps its error and no numbers."""
    error = F.lit(None).cast("string") if error is None else error
    return F.struct(
        F.lit(order).alias("ord"),
        F.lit(model).alias("model"),
        F.when(error.isNull(), prob).cast("double").alias("prob"),
        F.when(error.isNull(), scam_type).alias("type"),
        error.alias("error"),
    )


def slots(scores: Column, members: int) -> list[Column]:
    """The array's elements one by one.

    An ensemble has a fixed, small number of members, so everything below is spelled
    out per member: the optimiser then drops the array and compiles plain columns.
    """
    return [F.get(scores, F.lit(i)) for i in range(members)]


def _live(slot: Column) -> Column:
    """The member answered: it did not fail and was not left out."""
    return slot["error"].isNull() & slot["prob"].isNotNull()


def _hit(slot: Column, threshold: float) -> Column:
    return slot["error"].isNull() & reaches(slot["prob"], threshold)


def any_reaches(scores: list[Column], threshold: float = fixed.FRAUD_THRESHOLD) -> Column:
    return reduce(or_, [_hit(s, threshold) for s in scores], F.lit(False))


def trigger_models(scores: list[Column], threshold: float = fixed.FRAUD_THRESHOLD) -> Column:
    """Names of the members that reach the threshold, in member order."""
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.when(_hit(s, threshold), F.array(s["model"])).otherwise(none) for s in scores])


def details(scores: list[Column]) -> Column:
    """Map from model to its probability and type, in member order."""
    none = F.array().cast("array<struct<key:string,value:struct<prob:double,type:string>>>")
    entry = lambda s: F.struct(
        s["model"].alias("key"), F.struct(s["prob"].alias("prob"), s["type"].alias("type")).alias("value")
    )
    return F.map_from_entries(
        F.concat(none, *[F.when(_live(s), F.array(entry(s))).otherwise(none) for s in scores])
    )


def verdict(scores: list[Column], threshold: float = fixed.FRAUD_THRESHOLD) -> Column:
    return F.struct(
        any_reaches(scores, threshold).alias("is_fraud"),
        trigger_models(scores, threshold).alias("trigger_models"),
        details(scores).alias("details"),
    )


def voters(scores: list[Column]) -> Column:
    """How many members answered."""
    return reduce(add, [_live(s).cast("int") for s in scores], F.lit(0))


def mean_confidence(scores: list[Column]) -> Column:
    """Mean probability of the members that answered; null when none did."""
    total = reduce(add, [F.when(_live(s), s["prob"]).otherwise(F.lit(0.0)) for s in scores], F.lit(0.0))
    return F.try_divide(total, voters(scores))


def strongest(details_map: Column) -> Column:
    """Model with the highest probability above zero; the first name wins a tie."""
    entries = F.sort_array(
        F.transform(
            F.map_entries(details_map),
            lambda e: F.struct(e["key"].alias("model"), e["value"]["prob"].alias("prob")),
        )
    )
    start = F.struct(F.lit(fixed.NO_MODEL).alias("model"), F.lit(0.0).alias("prob"))
    better = lambda e, acc: (e["prob"] > acc["prob"]) & ~F.isnan(e["prob"])
    return F.aggregate(entries, start, lambda acc, e: F.when(better(e, acc), e).otherwise(acc))


def detection_json(detection: Column) -> Column:
    """The verdict as JSON indented by two spaces, keys in stored order."""

    def block(items, opening, closing, indent):
        full = lambda lines: F.concat(F.lit(opening + "\n"), lines, F.lit("\n" + " " * indent + closing))
        return bind(
            F.array_join(items, ",\n"),
            lambda lines: F.when(lines == "", F.lit(opening + closing)).otherwise(full(lines)),
        )

    models = F.transform(detection["trigger_models"], lambda m: F.concat(F.lit("    "), quoted(m)))
    members = F.transform(
        F.map_entries(detection["details"]),
        lambda e: F.concat(
            F.lit("    "), quoted(e["key"]),
            F.lit(': {\n      "prob": '), F.coalesce(e["value"]["prob"].cast("string"), F.lit("null")),
            F.lit(',\n      "type": '), F.coalesce(quoted(e["value"]["type"]), F.lit("null")),
            F.lit("\n    }"),
        ),
    )
    return F.concat(
        F.lit('{\n  "is_fraud": '), detection["is_fraud"].cast("string"),
        F.lit(',\n  "trigger_models": '), block(models, "[", "]", 2),
        F.lit(',\n  "details": '), block(members, "{", "}", 2),
        F.lit("\n}"),
    )
