"""Scalar column helpers (J1-J15): all built-in Catalyst expressions.

Every helper returns a ``Column``, so it stays JVM-side; no Python UDF is used
here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .literals import json_text

EPOCH_TEXT = "1970-01-01 00:00:00"

# Schema of the event ``value`` dictionary (its keys in the data
# dictionary are amount, offer_id and reward).
VALUE_SCHEMA = "amount DOUBLE, offer_id STRING, reward INT"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hours_to_timestamp(c) -> Column:
    """Hours since the Unix epoch -> TIMESTAMP_NTZ (``to_datetime(unit='h')``).

    Fractions of an hour are kept to the microsecond.
    """
    micros = F.round(col(c).cast("double") * F.lit(3_600_000_000.0)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit(EPOCH_TEXT).cast(T.TimestampNTZType()))


def to_timestamp_if_hours(df, name: str = "time"):
    """Apply J1 to ``name`` when it holds hours: any numeric type, or numbers
    as text.  Timestamps pass through (J1 is idempotent); a zoned timestamp
    becomes its wall clock time.  Any other type is an error."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return df
    if isinstance(dtype, T.TimestampType):
        return df.withColumn(name, F.col(name).cast(T.TimestampNTZType()))
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(name, F.timestamp_add("HOUR", F.col(name).cast("bigint"),
                                                   F.lit(EPOCH_TEXT).cast(T.TimestampNTZType())))
    if isinstance(dtype, T.NumericType):
        return df.withColumn(name, hours_to_timestamp(name))
    if isinstance(dtype, T.StringType):
        hours = F.expr(f"CAST(`{name}` AS DOUBLE)")
        return df.withColumn(name, hours_to_timestamp(hours))
    raise TypeError(f"{name} is {dtype.simpleString()}: neither hours nor timestamps")


def days_between(start, end) -> Column:
    """Floor of whole days from ``start`` to ``end`` (``Timedelta.days``).

    A difference of wall clock times: the session's zone plays no part."""
    return F.floor(micros_between(start, end) / F.lit(86_400_000_000)).cast("int")


def micros_between(start, end) -> Column:
    """Microseconds from ``start`` to ``end`` on the wall clock."""
    ntz = T.TimestampNTZType()
    return F.timestamp_diff("MICROSECOND", col(start).cast(ntz), col(end).cast(ntz))


#: Options of the JSON reader for what Python's strings may hold as they are.
_READER = {"allowSingleQuotes": "true", "allowUnquotedControlChars": "true"}


def parse_list(c) -> Column:
    """Python list literal text ``"['a', 'b']"`` -> ARRAY<STRING>.

    No ``eval``: the literal becomes JSON (:mod:`.literals`), which Spark reads.
    ``None`` elements are NULL and tuples are lists; malformed text gives NULL.
    """
    return F.from_json(json_text(col(c)), T.ArrayType(T.StringType()), _READER | {"mode": "PERMISSIVE"})


def parse_dict(c, schema: str = VALUE_SCHEMA) -> Column:
    """Python dict literal text -> STRUCT (``{'amount': 4.5}``); a ``None``
    value is NULL and leaves the other keys alone."""
    return F.from_json(json_text(col(c)), schema, _READER)


def right_closed_bins(c, edges: list[float], labels: list[str]) -> Column:
    """``pd.cut`` with right-closed bins ``(e0, e1], (e1, e2], ...``.

    Values outside every bin get NULL (pandas NaN).
    """
    expr = None
    x = col(c)
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def round2(c) -> Column:
    """``round(2)`` of pandas (half to even)."""
    return F.bround(col(c), 2)


def clamp_nonneg(c) -> Column:
    """``max(x, 0)``; NULL stays NULL."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def bool_mean(c) -> Column:
    """Mean of a boolean column (share of true)."""
    return F.avg(col(c).cast("int"))


def safe_ratio(num, den) -> Column:
    """Division that yields NULL for a zero or NULL denominator (ANSI-safe)."""
    return F.try_divide(col(num), col(den))


def attach_scalars(df, stats):
    """Attach a one-row statistics frame (a global aggregate) to every row.

    The side is one row by construction (an aggregate without grouping), so
    broadcasting it is size-safe; the large side is neither shuffled nor
    re-planned, and each statistic appears once in the plan.  (Scalar
    subqueries re-plan their input once per reference, which multiplies when
    statistics are nested.)
    """
    return df.crossJoin(F.broadcast(stats))


def materialize(df):
    """Cut the lineage of a derived input that a multi-pass operator reads
    several times: ``checkpoint()`` writes it once to the shared folder named
    by ``spark.checkpoint.dir`` (reliable, survives executor loss), so the
    passes read those files instead of re-running the upstream shuffles."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
