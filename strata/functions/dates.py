"""Column functions on times given as unix seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.config import DAY, DEAD_AFTER, GROWING_WITHIN, HALF_LIFE_DAYS


def fmt_date(secs: Column) -> Column:
    """``YYYY-MM-DD`` of unix seconds (the session's time zone is UTC)."""
    return F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd")


def classify(anchor: Column, birth: Column, touched: Column) -> Column:
    """dead if untouched for more than 180 days before the anchor, else growing if born within 90 days of it, else flat."""
    return F.when(touched.isNull() | birth.isNull(), None).when(anchor - touched > DEAD_AFTER, "dead").when(anchor - birth <= GROWING_WITHIN, "growing").otherwise("flat")


def recency(anchor: Column, secs: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """Weight that halves every half-life before the anchor."""
    return F.pow(F.lit(0.5), (anchor - secs) / F.lit(half_life_days * DAY))
