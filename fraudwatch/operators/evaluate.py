"""Evaluation of predicted against true classes.

Everything derives from one small (true, predicted, count) table, so the corpus
is read and combined once whatever the class balance.
"""

from pyspark.sql import DataFrame, functions as F

from fraudwatch import fixed
from fraudwatch.functions.scores import reaches
from fraudwatch.functions.text import contains_either, preview


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """Every (true, predicted) cell of the given classes, zeros included, and every other cell that occurs.

    A class outside the list and a missing value are cells of their own, so the
    counts always sum to the rows.
    """
    kind = df.schema[truth].dataType.simpleString()
    domain = F.array(*[F.lit(c) for c in classes]).cast(f"array<{kind}>")
    cells = (
        df.sparkSession.range(1)
        .select(F.explode(domain).alias("t"))
        .select("t", F.explode(domain).alias("p"))
        .withColumn("given", F.lit(True))
    )
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).cast(kind).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    met = cells.join(counts, F.col("t").eqNullSafe(F.col("truth")) & F.col("p").eqNullSafe(F.col("predicted")), "full_outer")
    pick = lambda mine, theirs: F.when(F.col("given"), F.col(mine)).otherwise(F.col(theirs))
    return met.select(
        pick("t", "truth").alias("truth"), pick("p", "predicted").alias("predicted"), F.coalesce("n", F.lit(0)).alias("n")
    )


def _per_class(cells: DataFrame) -> DataFrame:
    """True positives, predicted and actual totals of each class, a missing value among them, from the cells."""
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("class"), F.col("n").alias("actual"), F.lit(0).alias("named")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).alias("actual"), F.col("n").alias("named")),
            )
        ).alias("s"),
        F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
    )
    return sides.groupBy("s.class").agg(
        F.expr("sum(hit) div 2").alias("tp"),
        F.sum("s.named").alias("named"),
        F.sum("s.actual").alias("support"),
    )


def _rates(cells: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return (
        _per_class(cells)
        .withColumn("precision", ratio("tp", "named"))
        .withColumn("recall", ratio("tp", "support"))
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(
                    2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
                ),
                F.lit(0.0),
            ),
        )
    )


def class_report(df: DataFrame, truth: str, predicted: str, classes: list, digits: int = 4) -> DataFrame:
    rates = _rates(confusion(df, truth, predicted, classes))
    rounded = [F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")]
    return rates.select("class", *rounded, "support")


def report_summary(df: DataFrame, truth: str, predicted: str, classes: list, digits: int = 4) -> DataFrame:
    """Accuracy, plain class average and support-weighted average as three rows."""
    rates = _rates(confusion(df, truth, predicted, classes))
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    accuracy = F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0))
    row = lambda name, p, r, f: F.struct(
        F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1")
    )
    one = rates.agg(
        F.array(
            row("accuracy", accuracy, accuracy, accuracy),
            row("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
            row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
        ).alias("rows"),
        F.sum("support").alias("support"),
    )
    rounded = [F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")]
    return one.select(F.inline("rows"), "support").select("row", *rounded, "support")


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of rows that are predicted right; a missing prediction is not."""
    right = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False))
    return df.agg(F.avg(right.cast("double")).alias("accuracy"))


def false_positive_rate(df: DataFrame, truth: str, predicted: str, normal=0) -> DataFrame:
    """Normal messages, those taken for scam, those without a prediction, and the rate over the predicted ones."""
    is_normal = F.col(truth) == F.lit(normal)
    counts = df.agg(
        F.count_if(is_normal).alias("normals"),
        F.count_if(is_normal & (F.col(predicted) != F.lit(normal))).alias("false_positives"),
        F.count_if(is_normal & F.col(predicted).isNull()).alias("missing"),
    )
    return counts.withColumn("rate", F.try_divide(F.col("false_positives"), F.col("normals") - F.col("missing")))


def fp_samples(
    df: DataFrame, truth: str, predicted: str, key: str, count: int = 5, length: int = 60, normal=0
) -> DataFrame:
    """The first normal messages taken for scam, as a top-k with a short preview."""
    wrong = df.filter((F.col(truth) == F.lit(normal)) & (F.col(predicted) != F.lit(normal)))
    return wrong.orderBy(key).limit(count).select(key, preview(F.col("content"), length).alias("preview"))


def binary_confusion(
    df: DataFrame, truth: str, prob: str, threshold: float = fixed.FRAUD_THRESHOLD, inclusive: bool = True
) -> DataFrame:
    named = df.select(
        F.col(truth).cast("int").alias("truth"),
        reaches(F.col(prob), threshold, inclusive).cast("int").alias("predicted"),
    )
    return confusion(named, "truth", "predicted", [0, 1])


def containment_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of rows where one text contains the other; zero without rows."""
    match = contains_either(F.col(truth), F.col(predicted)).cast("double")
    return df.agg(F.coalesce(F.avg(match), F.lit(0.0)).alias("accuracy"))
