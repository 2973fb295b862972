"""Session helpers: durable cuts, spreading, and checks before broadcasting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is counted and stays below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where nothing is set a local session (a test) gets a temporary folder; on a cluster the
    executors would each write to a disk of their own, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="veilframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Materialise a result that several later steps read: computed once, survives the
    loss of executors because it lies in the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Inputs of more splits than this are never shuffled just to use more cores.
SPREAD_MAX_SPLITS = 64


def spread(df: DataFrame, *keys: str, task_rows: int | None = None) -> DataFrame:
    """Give CPU-heavy work on a small input a task per core.

    Only for scans of fewer splits than cores, and of at most ``SPREAD_MAX_SPLITS``
    (8 GB at the default split size): larger inputs are read as they lie.  For narrow rows
    that cost much, ``task_rows`` bounds the rows of a task instead, whatever the splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if task_rows is not None:
        # files hold their number of rows: no column is read
        wanted = max(cores, -(-df.count() // task_rows))
        return df if splits >= wanted else df.repartition(wanted, *keys)
    if splits >= min(cores, SPREAD_MAX_SPLITS):
        return df
    return df.repartition(cores, *keys)


def small(df: DataFrame, *text_columns: str) -> bool:
    """Whether ``df`` was counted and fits the broadcast bounds."""
    head = df.select(*text_columns).limit(BROADCAST_ROWS + 1)
    chars = F.lit(0)
    for name in text_columns:
        chars = chars + F.coalesce(F.length(F.col(name).cast("string")), F.lit(0))
    rows, total = head.agg(F.count(F.lit(1)), F.sum(chars)).first()
    return rows <= BROADCAST_ROWS and (total or 0) <= BROADCAST_CHARS


def salted_join(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    spread_by: str,
    salts: int = 32,
    how: str = "inner",
) -> DataFrame:
    """Join many facts to a dimension with unique ``key`` when any key may be hot.

    Facts of one key go to ``salts`` tasks; the dimension is copied once per salt.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    copies = dimension.withColumn(
        "_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)"))
    )
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


#: A key with at least this share of all facts is joined by broadcast.
HOT_SHARE = 0.001


def hot_split_join(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    value: str,
    weight: str,
    spread_by: str,
) -> DataFrame:
    """``facts`` plus ``value`` (null where the dimension lacks the key).

    ``weight`` counts how many facts a key has, so the hot keys are known beforehand:
    at most ``1 / HOT_SHARE`` rows reach the share, which bounds what is broadcast.  Hot
    facts are answered in place and shuffled under a key of their own row; the others
    meet the rest of the dimension.  One pass over the facts, no copies.
    """
    total = dimension.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) >= F.lit(total * HOT_SHARE)
    hot = dimension.where(is_hot).select(F.col(key), F.col(value).alias("_hot"))
    cold = dimension.where(~is_hot).select(
        F.col(key).alias("_join"), F.col(value).alias("_cold")
    )
    answered = facts.join(F.broadcast(hot), key, "left")
    own = F.concat(F.lit("\u0000"), F.xxhash64(spread_by, key).cast("string"))
    routed = answered.withColumn(
        "_join", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(own)
    )
    return (
        routed.join(cold, "_join", "left")
        .withColumn(value, F.coalesce("_hot", "_cold"))
        .drop("_join", "_hot", "_cold")
    )
