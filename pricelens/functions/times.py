"""Timestamp helpers that do not depend on the session or process time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_RE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def ts_lit(dt: datetime) -> Column:
    """A naive datetime becomes a ``TIMESTAMP_NTZ`` literal (wall clock, no
    zone); an aware one an exact instant.  ``F.lit`` of a naive datetime would
    read it in the Python process's local zone."""
    if dt.tzinfo is None:
        return F.lit(dt.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.lit(dt)


def parse_iso_timestamp(text) -> Column:
    """ISO-8601 text -> timestamp; text without an offset means UTC; bad text -> NULL."""
    t = F.col(text) if isinstance(text, str) else text
    with_zone = F.when(t.rlike(OFFSET_RE), t).otherwise(F.concat(t, F.lit("Z")))
    return with_zone.try_cast("timestamp")


def iso_text(ts, aware: bool = False) -> Column:
    """Timestamp -> ISO-8601 text the way Python's ``isoformat`` writes it:
    microseconds only when non-zero; with ``aware`` the zone offset
    (``+00:00`` style) of the instant in the session zone."""
    t = F.col(ts) if isinstance(ts, str) else ts
    micros = F.date_format(t, "SSSSSS")
    text = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")))
    return F.concat(text, F.date_format(t, "xxx")) if aware else text
