"""Column expressions over class labels and scam types."""

from pyspark.sql import Column, functions as F

from fraudwatch import fixed


def canonical_label(label: Column) -> Column:
    """``0.0`` and ``0`` are one label."""
    return F.regexp_replace(label, r"^(\d+)\.0+$", "$1")


def stage1_label(class_id: Column) -> Column:
    return (class_id != 0).cast("int")


def stage2_label(class_id: Column) -> Column:
    """Scam classes 1..4 become 0..3, normal becomes -1."""
    return (class_id - 1).cast("int")


def actual_class(stage1: Column, stage2: Column) -> Column:
    return F.when(stage1 == 0, F.lit(0)).otherwise(stage2 + 1).cast("int")


def fine_label(label: Column) -> Column:
    return F.when(label == "0", F.lit(fixed.NORMAL)).otherwise(label)


def cost_weight(stage1: Column) -> Column:
    return F.when(stage1 == 0, F.lit(fixed.NORMAL_WEIGHT)).otherwise(F.lit(fixed.SCAM_WEIGHT))


def class_name(class_id: Column) -> Column:
    names = F.array(*[F.lit(name) for name in fixed.CLASS_NAMES])
    return F.get(names, class_id)


def counted_type(scam_type: Column) -> Column:
    """Type used by counters: only a missing value is replaced."""
    return F.coalesce(scam_type, F.lit(fixed.UNKNOWN_TYPE))


def shown_type(scam_type: Column) -> Column:
    """Type used on screens: an empty text is replaced as well."""
    return F.coalesce(F.nullif(scam_type, F.lit("")), F.lit(fixed.SUSPECTED_TYPE))


def canonical_type(scam_type: Column) -> Column:
    """One of the known names for any spelling a member may emit."""
    plain = F.regexp_replace(scam_type, r"\s*\(\d+\)$", "")
    rules = None
    for word, name in fixed.CANONICAL_RULES:
        hit = F.contains(plain, F.lit(word))
        rules = F.when(hit, F.lit(name)) if rules is None else rules.when(hit, F.lit(name))
    return rules.otherwise(F.when(plain.isNotNull(), F.lit(fixed.OTHER_SCAM)))
