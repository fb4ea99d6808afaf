"""Wall-clock literals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_clock(value: str | dt.datetime | dt.date | None) -> Column:
    """A timestamp without time zone; neither the session's nor the machine's zone shifts it."""
    text = value.isoformat() if isinstance(value, dt.date) else value
    return F.lit(text).cast("timestamp_ntz")
