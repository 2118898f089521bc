"""Explicit schemas of every stored or parsed record."""

from pyspark.sql import types as T

from fraudwatch.fixed import ARCHIVE_FIELDS


def _fields(pairs):
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

CORPUS = _fields([("content", _S), ("label", _S)])

MESSAGE = _fields(
    [("uid", _S), ("mailbox", _S), ("from", _S), ("subject", _S), ("body", _S), ("date", _S)]
)

SCORE = _fields([("ord", T.IntegerType()), ("model", _S), ("prob", _D), ("type", _S), ("error", _S)])
SCORES = T.ArrayType(SCORE)

DETAIL = _fields([("prob", _D), ("type", _S)])
VERDICT = _fields(
    [
        ("is_fraud", T.BooleanType()),
        ("trigger_models", T.ArrayType(_S)),
        ("details", T.MapType(_S, DETAIL)),
    ]
)

GENERATED_ARCHIVE = _fields([(name, _S) for name in ARCHIVE_FIELDS])
ARCHIVE = _fields([(name, _S) for name in ARCHIVE_FIELDS + ["content", "error"]])

REPORT = _fields(
    [
        ("id", _S),
        ("mailbox", _S),
        ("status", _S),
        ("timestamp", _TS),
        ("detection", VERDICT),
        ("data", ARCHIVE),
    ]
)

MAILBOX = _fields(
    [
        ("email", _S),
        ("added_at", _TS),
        ("last_checked", _TS),
        ("status", _S),
        ("intercept_count", _L),
    ]
)

STATS = _fields(
    [
        ("total_intercepted", _L),
        ("daily_counts", T.MapType(_S, _L)),
        ("type_distribution", T.MapType(_S, _L)),
    ]
)

FEEDBACK = _fields([("content", _S), ("label", _S), ("timestamp", _TS)])
