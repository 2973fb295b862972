"""Which rows may be among some others, told before any shuffle by a broadcast bit filter.

Every member sets one bit, found by its 64-bit hash; a row whose bit is unset is no member
for certain.  The filter has ``BITS_PER_MEMBER`` bits per member, as a power of two, and at
most ``MAX_BITS``, which bounds what is broadcast (64 MB); beyond that it grows denser and
more rows are taken for possible members.  A possible member must be joined to be sure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, spread_free
from .exact_dedup import MAX_BITS, MIN_BITS

BITS_PER_MEMBER = 16


def may_be_among(df: DataFrame, hashed: str, members: DataFrame, member: str, out: str) -> DataFrame:
    """``df`` plus ``out``: false if the long ``hashed`` is not in ``member`` for certain."""
    n, bits = members.count(), MIN_BITS
    while bits < min(n * BITS_PER_MEMBER, MAX_BITS):
        bits *= 2
    place = F.pmod(F.col(member), F.lit(bits)) + 1  # bitmap functions count from 1
    part, bitmap = spread_free("_part", df.columns), spread_free("_bitmap", df.columns)
    parts = settled(
        members.select(place.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias(part))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(bitmap)),
        "members",
    )
    mine = F.pmod(F.col(hashed), F.lit(bits)) + 1
    bit = F.bitmap_bit_position(mine)
    byte = F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), F.pmod(bit, F.lit(8)).cast("int"))
    # at most bits / 32768 rows of 4 KB: bounded by MAX_BITS
    tested = df.join(F.broadcast(parts), F.bitmap_bucket_number(mine) == F.col(part), "left")
    return tested.withColumn(out, F.coalesce(is_set == 1, F.lit(False))).drop(part, bitmap)
