"""From model outputs to probabilities and the two-stage decision."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, functions as F

from fraudwatch import fixed
from fraudwatch.functions.scores import reaches


def softmax_scam(logit_normal: Column, logit_scam: Column) -> Column:
    """Class-1 probability of two logits, written so that it cannot overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(logit_normal.cast("double") - logit_scam.cast("double")))


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def scam_probability(probability: Column) -> Column:
    """Class-1 entry of a Spark ML probability vector."""
    return vector_to_array(probability)[1]


def cascade(
    prob: Column, stage2: Column, threshold: float = fixed.FRAUD_THRESHOLD, inclusive: bool = True
) -> Column:
    """Scam class 1..4 where stage 1 reaches the threshold, else 0."""
    return F.when(reaches(prob, threshold, inclusive), stage2 + 1).otherwise(F.lit(0)).cast("int")
