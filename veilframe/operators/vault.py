"""Token vault and unredaction.

The vault is a table ``(token, label, text, n)`` written next to the redacted data, ``n``
being the number of occurrences; it is as sensitive as the originals.

Unredaction first counts the distinct tokens of the texts (partial sums per task) and fetches
their originals, so a vault of any size shrinks to what these texts need.  If that is counted
and small, it goes to every task as one dictionary and the tokens are put back inside the
row: nothing but tokens is ever shuffled.  Otherwise the tokens, without texts, are joined to
their originals, hot ones by a broadcast, and each row's originals meet its text by key; on a
table that is stored in buckets of the key (``store_bucketed``) the texts do not move there
either.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import empty, indices, running_starts
from ..functions.spans import cut, mark_safe, splice
from ..functions.sql import col, fn, lit, struct
from ..functions.tokens import TOKEN_REGEX
from ..session import checkpoint_dir, hot_split_join, settle, small


def vault_of(redacted: DataFrame, spans: str = "spans") -> DataFrame:
    """Distinct tokens of redacted rows, the text they stand for, and their number.

    Partial aggregation removes repeats before the shuffle, so a value that fills a third
    of all rows is still one row per task.
    """
    tokens = fn.filter(
        col(spans), lambda s: s["new_text"].rlike(f"^{TOKEN_REGEX}$")
    )
    listed = redacted.select(F.explode(tokens.column()).alias("_s"))
    return listed.groupBy(
        F.col("_s.new_text").alias("token"),
        F.col("_s.label").alias("label"),
        F.col("_s.text").alias("text"),
    ).agg(F.count(F.lit(1)).alias("n"))


def collisions(vault: DataFrame) -> DataFrame:
    """Tokens that stand for more than one text: widen the tokens until none is left."""
    return (
        vault.groupBy("token")
        .agg(F.countDistinct("text").alias("n_texts"))
        .where("n_texts > 1")
    )


def merge_vault(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per token of both, occurrences added up."""
    return (
        old.unionByName(new)
        .groupBy("token", "label", "text")
        .agg(F.sum("n").alias("n"))
    )


def tokens_in(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, token, start, end): tokens of each text in order."""
    located = (
        df.select(key, text)
        .withColumn("_pieces", cut(mark_safe(col(text)), TOKEN_REGEX).column())
        .withColumn(
            "_starts",
            running_starts(fn.transform(col("_pieces"), lambda p: fn.length(p))).column(),
        )
    )
    found = fn.transform(
        indices(fn.size(col("_pieces")) - 1, step=2, first=1),
        lambda i: struct(
            start=col("_starts")[i],
            end=col("_starts")[i] + fn.length(col("_pieces")[i]),
            token=col("_pieces")[i],
        ),
    )
    return located.select(key, F.explode(found.column()).alias("_t")).select(
        key, "_t.start", "_t.end", "_t.token"
    )


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """(token, n): the distinct tokens of the texts, counted per task before the shuffle."""
    found = fn.regexp_extract_all(col(text), lit(TOKEN_REGEX), lit(0))
    return (
        df.select(F.explode(found.column()).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def put_back(text: Column, originals: dict[str, str]) -> Column:
    """``text`` with every token that ``originals`` knows replaced, inside the row."""
    shape = re.compile(TOKEN_REGEX)

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def original(match: re.Match) -> str:
            return originals.get(match[0], match[0])

        for batch in batches:
            yield pd.Series([None if t is None else shape.sub(original, t) for t in batch], dtype=object)

    return back(text)


def unredact(
    df: DataFrame,
    vault: DataFrame,
    key: str,
    text: str = "redacted_text",
    broadcast: bool = True,
) -> DataFrame:
    """``df`` plus ``unredacted_text``; tokens the vault does not know stay.

    ``vault`` is read more than once: give the stored table, not its computation.
    ``broadcast`` False takes the join whatever the number of tokens.
    """
    originals = vault.groupBy("token").agg(F.min("text").alias("_original"))
    needed = settle(token_counts(df, text).join(originals, "token"))
    if broadcast and small(needed, "token", "_original"):
        known = {r["token"]: r["_original"] for r in needed.select("token", "_original").collect()}
        return df.withColumn("unredacted_text", put_back(F.col(text), known))
    return _joined(df, needed, key, text)


def _joined(df: DataFrame, needed: DataFrame, key: str, text: str) -> DataFrame:
    """Unredaction where the originals are too many for a dictionary."""
    found = tokens_in(df, key, text)
    known = hot_split_join(found, needed, "token", "_original", "n", key)
    per_row = (
        known.where(F.col("_original").isNotNull())
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "_original"))).alias("_m"))
    )
    spans = fn.coalesce(col("_m"), empty("struct<start:int,end:int,_original:string>"))
    return (
        df.join(per_row, key, "left")
        .withColumn("_m", spans.column())
        .withColumn(
            "unredacted_text",
            splice(
                col(text), col("_m"), fn.transform(col("_m"), lambda m: m["_original"])
            ).column(),
        )
        .drop("_m")
    )


def store_bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` as a stored table in buckets of ``key``, in the shared folder: rows that meet it
    by key come to the texts, not the other way.

    As many buckets as shuffle partitions, so that neither side of such a join is dealt anew.
    """
    spark = df.sparkSession
    name = f"veilframe_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)
