"""Score arithmetic and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(distance, F.lit(0.0)))


def keyword_score(score: Column, rank: Column) -> Column:
    """Scores count less down the list: score / rank + 0.2, at most 1."""
    return F.least(F.lit(1.0), score / F.greatest(rank, F.lit(1)) + 0.2)


def label(score: Column, high: float, low: float) -> Column:
    return F.when(score >= high, "high").when(score >= low, "medium").otherwise("low")


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def interval_minutes(text: Column) -> Column:
    """'5m' or '2h' in minutes; anything else one minute."""
    n = F.regexp_extract(text, r"^(\d+)[mh]$", 1).try_cast("int")
    return F.coalesce(F.when(text.endswith("h"), n * 60).otherwise(n), F.lit(1))


def parse_time(text: Column, hours: int = 0) -> Column:
    """'yyyy-MM-dd HH:mm:ss', or now plus `hours` where it does not parse."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.current_timestamp() + F.expr(f"INTERVAL {hours} HOURS"))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)
