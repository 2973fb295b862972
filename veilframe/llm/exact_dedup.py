"""Exact de-duplication by two passes over a Bloom filter of the texts' hashes.

Pass one tells which bits of the filter at least two rows set.  A filter per task would have
to be sent whole by every task, so its set bits are sent instead: two numbers of eight bytes
for each row, no text and no hash, counted per task before the shuffle and joined into the
filter's parts after it.  Pass two looks up both bits of every row where it lies: a row with a bit
that no other row sets holds a text that no other row holds and passes straight through;
only the rest, the possibly repeated, is shuffled and compared by SHA-256 of the whole text.
A false positive costs one row's shuffle, never a wrong answer.  All of it is DataFrame
functions.

The filter has ``BITS_PER_ROW`` bits per row, as a power of two.  One filter has at most
``MAX_BITS`` (64 MB broadcast at 2**29 bits); a table that needs more is first written in
ranges of another hash, and every range has a filter of its own, one after the other.  So
the filter is as sparse for billions of rows as for thousands.

Results for special rows: a null text counts as empty, so null and empty texts are copies
of each other; a null key is the smallest; rows equal in key and text are one kept row and
its copies; an empty table gives an empty table; the operator's own columns have names
that no input column has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import attach, settled, shared_path, spread_free

BITS_PER_ROW = 16
MAX_BITS = 1 << 29
MIN_BITS = 1 << 15
#: Bits of one bitmap that Spark's bitmap functions build.
PART_BITS = 32768


def whole_text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def filter_size(rows: int) -> tuple[int, int]:
    """Bits of a filter, and number of ranges that have one each."""
    bits, ranges = MIN_BITS, 1
    while bits * ranges < rows * BITS_PER_ROW:
        if bits < MAX_BITS:
            bits *= 2
        else:
            ranges *= 2
    return bits, ranges


def positions(text: Column, bits: int) -> Column:
    """Two places of the text's hash in a filter of ``bits`` bits, from 0."""
    return F.array(
        F.pmod(F.xxhash64(text), F.lit(bits)),
        F.pmod(F.xxhash64(F.lit(1), text), F.lit(bits)),
    )


def repeated_bits(places: DataFrame) -> DataFrame:
    """Parts (part, bitmap) of the filter with the bits that two rows or more have set.

    ``places`` has ``at``, a place per row and hash.
    """
    twice = places.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # bitmap functions count from 1
    return twice.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bitmap")
    )


def possibly_repeated(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` plus ``out``: false if no other row has the same text, for certain."""
    bits, ranges = filter_size(df.select(F.count(F.lit(1))).first()[0])
    if ranges == 1:
        return _tested(df, text, out, bits)
    part = spread_free("_range", df.columns)
    path = shared_path(df.sparkSession, "ranges")
    at = F.pmod(F.xxhash64(F.lit(2), whole_text(text)), F.lit(ranges)).cast("int")
    df.withColumn(part, at).write.partitionBy(part).parquet(path)
    written = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField(part, IntegerType())])).parquet(path)
    found = [
        settled(_tested(written.where(F.col(part) == r).drop(part), text, out, bits), "tested")
        for r in range(ranges)
    ]
    return reduce(DataFrame.unionByName, found)


def _tested(df: DataFrame, text: str, out: str, bits: int) -> DataFrame:
    """``possibly_repeated`` by one filter."""
    whole = whole_text(text)
    places = df.select(F.explode(positions(whole, bits)).alias("at"))
    parts = settled(repeated_bits(places), "filter")
    own = {n: spread_free(n, df.columns) for n in ("_place", "_part", "_bitmap")}
    place, part, bitmap = own.values()
    tested = df.withColumn(place, positions(whole, bits)).withColumn(out, F.lit(True))
    for i in range(2):
        bit = F.bitmap_bit_position(F.col(place)[i] + 1)
        byte = F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        is_set = F.getbit(
            F.conv(F.hex(byte), 16, 10).cast("long"), F.pmod(bit, F.lit(8)).cast("int")
        )
        # at most bits / PART_BITS rows of 4 KB: bounded by MAX_BITS
        side = F.broadcast(parts.toDF(part, bitmap))
        tested = tested.join(
            side, F.bitmap_bucket_number(F.col(place)[i] + 1) == F.col(part), "left"
        )
        tested = tested.withColumn(
            out, F.col(out) & F.coalesce(is_set == 1, F.lit(False))
        ).drop(part, bitmap)
    return tested.drop(place)


def flagged(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, text_sha256, keep_id, group_size, kept) per row of ``df``; of equal
    texts the row with the largest key is kept."""
    tested = possibly_repeated(df.select(key, text), text, "_maybe")
    slim = settled(
        tested.select(
            F.col(key).alias("_id"), "_maybe", F.sha2(whole_text(text), 256).alias("text_sha256")
        ),
        "hashes",
    )
    one = F.lit(1).cast("long")
    alone = slim.where("NOT _maybe").select(
        "_id", "text_sha256", F.col("_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept")
    )
    rows = slim.where("_maybe").groupBy("text_sha256", "_id").agg(F.count(F.lit(1)).alias("_n"))
    groups = settled(
        slim.where("_maybe")
        .groupBy("text_sha256")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "groups",
    )
    found = attach(
        rows, groups, "text_sha256", "group_size", ["_id"], F.struct("keep_id", "group_size"), "_of"
    )
    # rows equal in key and text: one of them stands for all, the others are its copies
    copies = found.withColumn("_copy", F.explode(F.sequence(one, F.col("_n"))))
    shared = copies.select(
        "_id",
        "text_sha256",
        "_of.keep_id",
        "_of.group_size",
        (F.col("_id").eqNullSafe(F.col("_of.keep_id")) & (F.col("_copy") == 1)).alias("kept"),
    )
    return alone.unionByName(shared).withColumnRenamed("_id", key)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, whole: of equal texts the one with the largest key.
    Rows that cannot be repeated are not shuffled; copies are reduced before the shuffle."""
    maybe, sha, best = (spread_free(n, df.columns) for n in ("_maybe", "_sha", "_best"))
    tested = possibly_repeated(df, text, maybe)
    names = [F.col(c) for c in df.columns]
    whole = F.struct(*names)
    simple = [
        F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()
        and "variant" not in f.dataType.simpleString()
    ]
    order = F.struct(F.col(key), F.xxhash64(*simple))
    many = (
        tested.where(F.col(maybe))
        .groupBy(F.sha2(whole_text(text), 256).alias(sha))
        .agg(F.max_by(whole, order).alias(best))
        .select(f"{best}.*")
    )
    return tested.where(~F.col(maybe)).select(*names).unionByName(many)
