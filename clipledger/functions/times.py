"""Time arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def day_micros(c: Column) -> Column:
    """Microseconds since midnight of a zone-less timestamp."""
    seconds = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000
    return seconds + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp."""
    return F.unix_date(F.to_date(c)).cast("long") * DAY_US + day_micros(c)
