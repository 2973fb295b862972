"""Detection quality against gold spans, and picking the best model or version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import prefix_max


def _rates(tp: Column, n_predicted: Column, n_gold: Column) -> list[Column]:
    precision = F.try_divide(tp, n_predicted)
    recall = F.try_divide(tp, n_gold)
    f1 = F.try_divide(2 * tp, n_predicted + n_gold)
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def span_matches(
    predicted: DataFrame, gold: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """(keys..., start, end, n_predicted, n_gold): both sides counted per exact span.

    A union and one aggregation instead of a full outer join: duplicates on either side
    are counted once and partial aggregation works before the shuffle.
    """
    columns = [*keys, "start", "end"]
    ours = predicted.select(*columns, F.lit(1).alias("p"), F.lit(0).alias("g"))
    theirs = gold.select(*columns, F.lit(0).alias("p"), F.lit(1).alias("g"))
    return (
        ours.unionByName(theirs)
        .groupBy(*columns)
        .agg(F.max("p").alias("n_predicted"), F.max("g").alias("n_gold"))
    )


def scores(
    predicted: DataFrame, gold: DataFrame, keys: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., precision, recall, f1, entity_count) for exact matches.

    ``keys`` tell spans apart (file, label); ``by`` is the level of the report: none for
    overall figures, the file for per-file figures.
    """
    matched = span_matches(predicted, gold, keys)
    sums = matched.groupBy(*by).agg(
        F.sum(F.col("n_predicted") * F.col("n_gold")).alias("tp"),
        F.sum("n_predicted").alias("_p"),
        F.sum("n_gold").alias("_g"),
    )
    return sums.select(
        *by,
        "tp",
        (F.col("_p") - F.col("tp")).alias("fp"),
        (F.col("_g") - F.col("tp")).alias("fn"),
        *_rates(F.col("tp"), F.col("_p"), F.col("_g")),
        F.col("_g").alias("entity_count"),
    )


def overlap_recall(
    predicted: DataFrame, gold: DataFrame, document: str, label: str | None = None
) -> DataFrame:
    """(document, n_gold, n_hit): gold spans that some predicted span overlaps.

    One sweep over both lists: predicted spans stand where they begin, gold spans where they
    end, and a gold span is hit if the furthest end of the predicted spans that begin before
    its own end lies behind its start.  The furthest end is carried in blocks, so a document
    may hold any share of the spans.
    """
    keys = [document] + ([label] if label else [])
    ours = predicted.select(*keys, "start", "end").distinct()
    theirs = gold.select(*keys, "start", "end").distinct()
    # at one place gold spans come first: a predicted span that begins there is no overlap
    events = ours.select(
        *keys, (F.col("start").cast("bigint") * 2 + 1).alias("_at"), F.col("end").alias("_far"), F.lit(None).cast("int").alias("_gold")
    ).unionByName(
        theirs.select(
            *keys,
            (F.col("end").cast("bigint") * 2).alias("_at"),
            F.lit(None).cast(ours.schema["end"].dataType).alias("_far"),
            F.col("start").alias("_gold"),
        )
    )
    swept = prefix_max(events, keys, "_at", {"_furthest": F.col("_far")})
    return (
        swept.where(F.col("_gold").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_gold"),
            F.count_if(F.col("_furthest") > F.col("_gold")).cast("int").alias("n_hit"),
        )
    )


def best(df: DataFrame, name: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., name): highest score; the smallest name when scores tie."""
    order = F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))
    return df.groupBy(*by).agg(
        F.min_by(name, order).alias(name), F.max(score).alias(score)
    )


def latest_version(df: DataFrame, version: str, by: Sequence[str] = ()) -> DataFrame:
    """Highest version by number, whatever its text form ("10" after "9")."""
    return df.groupBy(*by).agg(
        F.max_by(version, F.col(version).cast("int")).alias("latest_version")
    )


def active(df: DataFrame, flag: str = "is_active") -> DataFrame:
    return df.where(F.col(flag))
