"""Shared pieces of the training-data operators: durable tables, ranks, hot-key joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators.ordered import prefix_sum
from veilframe.session import checkpoint_dir

#: Rows that a ranking window reads at most, on average.
RANK_ROWS = 256
#: A key with at least this share of all rows is hot; there are at most 1 / HOT_SHARE.
HOT_SHARE = 0.001
#: Rows that Spark hands to a Python function at once.
BATCH_ROWS = 1_000
#: UTF-8 bytes that a Python function works on at once.
BATCH_BYTES = 2_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/veilframe-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage cut, and
    safe from the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_free(name: str, taken: Iterable[str]) -> str:
    """``name``, or it with underscores in front until no column is called so."""
    lowered = {x.lower() for x in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name


def ranked(
    df: DataFrame, key: str, order: Sequence[str], out: str, rows: int = RANK_ROWS
) -> DataFrame:
    """``df`` plus ``out``: 0, 1, 2, ... within ``key``, any key as hot as may be.

    ``key`` must have few values (counted, and broadcast by their number of blocks).  The
    rows of a key go to blocks by the hash of ``order``; the rank is the place within the
    block plus the rows of the blocks before, which are added up in steps.  It depends on
    the rows alone, so a task that runs again gives the same ranks; ``order`` should tell
    all rows apart that differ elsewhere.
    """
    totals = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_blocks"))
    block = F.pmod(F.xxhash64(*order), F.col("_blocks"))
    cut = (
        df.join(F.broadcast(totals.withColumnRenamed(key, "_key")), F.col(key) == F.col("_key"))
        .withColumn("_block", block)
        .drop("_key", "_blocks")
    )
    counts = cut.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    bases = prefix_sum(counts, [key], "_block", F.col("_n"), "_base").select(
        F.col(key).alias("_key"), F.col("_block").alias("_at"), "_base"
    )
    window = Window.partitionBy(key, "_block").orderBy(*order)
    local = cut.withColumn("_place", F.row_number().over(window) - 1)
    return (
        local.join(bases, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_at")))
        .withColumn(out, F.col("_place").cast("long") + F.col("_base").cast("long"))
        .drop("_block", "_key", "_at", "_place", "_base")
    )


def attach(
    rows: DataFrame,
    groups: DataFrame,
    key: str,
    weight: str,
    spread_by: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """``rows`` plus ``out``: the ``value`` of their group, null where there is none.

    ``groups`` is a settled table with one row per ``key`` and the rows of the group as
    ``weight``.  The at most 1 / HOT_SHARE groups that hold so large a share of the rows
    are broadcast, and their rows dealt by ``spread_by``; the others are joined by key.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) >= F.lit(max(2.0, total * HOT_SHARE))
    hot = groups.where(is_hot).select(F.col(key).alias("_hot_key"), value.alias("_hot"))
    cold = groups.where(~is_hot).select(
        F.col(key).alias("_cold_key"), F.lit(0).cast("long").alias("_cold_spread"), value.alias("_cold")
    )
    answered = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    # a row that has its answer needs no partner: it goes where its own hash sends it
    spread = F.when(F.col("_hot_key").isNotNull(), F.xxhash64(*spread_by).bitwiseOR(1)).otherwise(0)
    return (
        answered.withColumn("_spread", spread)
        .join(
            cold,
            (F.col(key) == F.col("_cold_key")) & (F.col("_spread") == F.col("_cold_spread")),
            "left",
        )
        .withColumn(out, F.coalesce("_hot", "_cold"))
        .drop("_hot_key", "_hot", "_spread", "_cold_key", "_cold", "_cold_spread")
    )


def bound_batches() -> None:
    """Bounds what Spark hands to a Python function at once, by rows and bytes, in the
    active session.  Spark's own bound of 10,000 rows is some hundred megabytes of long
    texts, held twice in the JVM and twice in Python."""
    spark = SparkSession.active()
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 * BATCH_BYTES)


def by_bytes(texts: Sequence[str], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters, one text at least."""
    begin = size = 0
    for at, text in enumerate(texts):
        if at > begin and size + len(text) > most:
            yield begin, at
            begin, size = at, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """A column of texts (null as empty) in lists of about ``most`` bytes, so that Python
    never holds a whole Arrow batch of long texts beside its results."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    begin = done = 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield [t or "" for t in texts.slice(begin, stop - begin).to_pylist()]
        begin, done = stop, sizes[stop - 1]


def plain(texts: pd.Series) -> list[str]:
    """A column of texts as a list, null as the empty text."""
    return ["" if t is None else t for t in texts.tolist()]
