"""Epoch seconds <-> TIMESTAMP_NTZ without the session time zone.

Casting a wall-clock (NTZ) timestamp to an instant goes through
``spark.sql.session.timeZone``; these helpers treat wall clocks as UTC, so a
session in another zone computes the same epochs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "1970-01-01 00:00:00"


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970-01-01 00:00 of a TIMESTAMP_NTZ wall clock."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (F.unix_date(F.to_date(c)).cast("bigint") * 86400
            + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))).cast("bigint")


def from_epoch_seconds(secs: str | Column) -> Column:
    """TIMESTAMP_NTZ wall clock (UTC) of whole epoch seconds."""
    s = F.col(secs) if isinstance(secs, str) else secs
    return F.timestamp_add("SECOND", s, F.lit(_EPOCH).cast("timestamp_ntz"))


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def floor_time(ts: str | Column, unit: str) -> Column:
    """``date_trunc`` for wall clocks: TIMESTAMP_NTZ in, TIMESTAMP_NTZ out,
    independent of the session time zone (``date_trunc`` would go through it)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if unit in _SECONDS:
        n = _SECONDS[unit]
        return from_epoch_seconds(F.floor(epoch_seconds(c) / n).cast("bigint") * n)
    zero = F.lit(0)
    if unit == "month":
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.lit(1), zero, zero, zero)
    if unit == "year":
        return F.make_timestamp_ntz(F.year(c), F.lit(1), F.lit(1), zero, zero, zero)
    raise ValueError(f"unsupported unit {unit}")
