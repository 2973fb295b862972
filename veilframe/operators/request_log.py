"""Request log: who asked for what, kept for a bounded number of hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the retention time in hours.
MIN_RETENTION_HOURS = 1
MAX_RETENTION_HOURS = 720


def check_retention(hours: int) -> int:
    if not MIN_RETENTION_HOURS <= hours <= MAX_RETENTION_HOURS:
        raise ValueError(
            f"retention_hours is {hours}; it may be {MIN_RETENTION_HOURS} to {MAX_RETENTION_HOURS}"
        )
    return hours


def records(
    redacted: DataFrame,
    at: Column,
    retention_hours: int,
    tags: Sequence[str] = (),
    text: str = "text",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Log rows for a redacted frame; the input is kept as a hash only.  ``keys`` are
    columns that name the request."""
    check_retention(retention_hours)
    return redacted.select(
        *keys,
        at.alias("ts"),
        F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"),
        F.lit(retention_hours).alias("retention_hours"),
        F.sha2(F.col(text), 256).alias("input_hash"),
        F.col("redacted_text").alias("result"),
    )


def purged(log: DataFrame, as_of: Column) -> DataFrame:
    """Rows whose retention has not run out at ``as_of``."""
    kept_until = F.col("ts") + F.make_dt_interval(hours=F.col("retention_hours"))
    return log.where(kept_until > as_of)


def with_tag(log: DataFrame, tag: str) -> DataFrame:
    return log.where(F.array_contains("tags", tag))
