"""Order-dependent sums over groups of any size.

A window over a whole group puts the group into one task, which fails when one group
holds a large share of all rows.  These operators cut a group by its integer order key
into blocks of ``2**bits`` rows, sum per block, and add the block heads back, so no task
sees more than one block (or one row per block at the top level).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Rows per block, as a power of two: small enough for rows that carry texts.
BLOCK_BITS = 13


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    bits: int = BLOCK_BITS,
    depth: int = 2,
) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` over earlier rows of the same group.

    ``order`` is a non-negative integer, unique within a group.  With the default depth a
    group is cut twice, so the top level sees one row per 2**26 order values.
    """
    keys = list(keys)
    before = (Window.unboundedPreceding, -1)
    if depth == 0:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(*before)
        return df.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)))
    block = f"_block{depth}"
    cut = df.withColumn(block, F.shiftright(F.col(order).cast("bigint"), bits))
    totals = cut.groupBy(*keys, block).agg(F.sum(value).alias("_total"))
    heads = prefix_sum(
        totals, keys, block, F.col("_total"), f"_head{depth}", bits, depth - 1
    ).drop("_total")
    window = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(*before)
    local = cut.withColumn(f"_local{depth}", F.sum(value).over(window))
    same = [local[k].eqNullSafe(heads[k]) for k in keys]
    joined = local.join(heads, [*same, local[block] == heads[block]], "left")
    total = F.coalesce(F.col(f"_local{depth}"), F.lit(0)) + F.coalesce(
        F.col(f"_head{depth}"), F.lit(0)
    )
    return joined.select(*[local[c] for c in df.columns], total.alias(out))


def dense_index(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "row_idx", **cut: int
) -> DataFrame:
    """Position 0, 1, 2, ... of a row within its group, in ``order``."""
    return prefix_sum(df, keys, order, F.lit(1).cast("bigint"), out, **cut)


def prefix_max(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
    bits: int = BLOCK_BITS,
    depth: int = 2,
) -> DataFrame:
    """``df`` plus, per name in ``values``, the greatest value of the earlier rows of the same
    group, null where there is none; cut into blocks like ``prefix_sum``."""
    keys = list(keys)
    before = (Window.unboundedPreceding, -1)
    if depth == 0:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(*before)
        return df.withColumns({name: F.max(value).over(window) for name, value in values.items()})
    block = f"_block{depth}"
    cut = df.withColumn(block, F.shiftright(F.col(order).cast("bigint"), bits))
    totals = cut.groupBy(*keys, block).agg(
        *[F.max(value).alias(f"_top_{name}") for name, value in values.items()]
    )
    heads = prefix_max(
        totals,
        keys,
        block,
        {f"_head{depth}_{name}": F.col(f"_top_{name}") for name in values},
        bits,
        depth - 1,
    ).drop(*[f"_top_{name}" for name in values])
    window = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(*before)
    local = cut.withColumns(
        {f"_local{depth}_{name}": F.max(value).over(window) for name, value in values.items()}
    )
    same = [local[k].eqNullSafe(heads[k]) for k in keys]
    joined = local.join(heads, [*same, local[block] == heads[block]], "left")
    return joined.select(
        *[local[c] for c in df.columns],
        *[
            F.greatest(F.col(f"_local{depth}_{name}"), F.col(f"_head{depth}_{name}")).alias(name)
            for name in values
        ],
    )


#: Bits of a row's place within its partition in Spark's increasing ids.
_PLACE_BITS = 33


def numbered(
    df: DataFrame, out: str = "row_number", order: Sequence[str | Column] = (), start: int = 0
) -> DataFrame:
    """``df`` plus ``out``: consecutive numbers from ``start``, in reading order or in
    ``order``, which the rows are then sorted by over all machines.

    First every row gets its partition and place, in a durable copy, so a task that runs
    again later meets the same places; then the partitions' sizes, one row each, are added up
    and broadcast.  Without ``order`` nothing is shuffled but those sizes.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = settle(df.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _PLACE_BITS)
    place = F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base")
    )
    joined = marked.join(F.broadcast(bases), part == F.col("_part"))
    number = F.col("_base") + place + F.lit(start)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], number.alias(out))
