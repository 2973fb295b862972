"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

A partial partition is one number of bytes per shard.  Each item starts as a partial
partition with its bytes in one place.  Differencing takes the two with the largest spread
and adds them in opposite order, the largest number of one to the smallest of the other,
until one is left.  An item is a group (all rows of one text) with at least 1/``DRIVER_ITEMS``
of all bytes, or the sum of the smaller groups that a hash puts together, a small part of a
shard.  The driver differences all items together, so that small groups level large ones;
only these sums reach it, never rows, and they do not depend on the number of tasks, nor
does the rule on the number of groups.

Results for special rows: a null text counts as empty, as one group with empty texts, and
its size is 1; a null key is a row like any other; equal rows share a shard and have slots
of their own; an empty table gives an empty table; other columns are not carried.  A group
larger than a shard's share cannot be balanced away: it has a shard to itself, and the
others are differenced over the shards left.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, ranked, settled

SHARDS = 16
#: Items into which the small groups are folded.
TASK_ITEMS = 1_000
#: Groups with at least this part of all bytes are items of their own.
DRIVER_ITEMS = 4_000
#: Both are at least so many times the number of shards.
SHARD_ITEMS = 16


def difference(items: Sequence[Sequence[int]]) -> tuple[list[list[int]], list[int]]:
    """Combines partial partitions of the same width.

    Returns for every item the place in the result of each of its numbers, and the sums.
    """
    width = len(items[0])
    nodes: list[tuple] = []  # (first, second, order of the first's places in the result)
    heap: list[tuple] = []
    for i, sums in enumerate(items):
        order = sorted(range(width), key=lambda p: -sums[p])
        nodes.append((i, None, order))
        held = [sums[p] for p in order]
        heap.append((held[-1] - held[0], len(nodes) - 1, held))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, one = heapq.heappop(heap)
        _, b, two = heapq.heappop(heap)
        sums = list(map(int.__add__, one, reversed(two)))
        order = sorted(range(width), key=sums.__getitem__, reverse=True)
        nodes.append((a, b, order))
        held = [sums[p] for p in order]
        heapq.heappush(heap, (held[-1] - held[0], len(nodes) - 1, held))
    _, root, total = heap[0]
    places: list[list[int]] = [[]] * len(items)
    stack = [(root, list(range(width)))]
    while stack:
        node, place = stack.pop()
        a, b, order = nodes[node]
        at = [0] * width
        for result, own in enumerate(order):
            at[own] = place[result]
        if b is None:
            places[a] = at
        else:
            stack.append((a, at))
            stack.append((b, at[::-1]))
    return places, total


def assigned(sizes: Sequence[int], shards: int) -> list[int]:
    """Shard of every item, by its size."""
    found = [0] * len(sizes)
    left = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    total, alone = sum(sizes), 0
    while len(left) > alone and shards - alone > 1 and sizes[left[alone]] * (shards - alone) > total:
        found[left[alone]] = alone
        total -= sizes[left[alone]]
        alone += 1
    rest = sorted(left[alone:])
    if rest:
        zeros = [0] * (shards - alone - 1)
        for i, place in zip(rest, difference([[sizes[i], *zeros] for i in rest])[0], strict=True):
            found[i] = alone + place[0]
    return found


def balanced(groups: DataFrame, item: str, size: str, shards: int = SHARDS) -> DataFrame:
    """Shard (item, shard) of every group; ``item`` is a string, unique."""
    most = max(DRIVER_ITEMS, SHARD_ITEMS * shards)
    folds = max(TASK_ITEMS, SHARD_ITEMS * shards)
    total = groups.agg(F.sum(size)).first()[0] or 0
    # by size, not by number: a table is treated alike however many groups it has
    least = -(-total // most)
    fold = F.concat(F.lit("~"), F.pmod(F.xxhash64(item), F.lit(folds)))
    part = F.when(F.col(size) >= least, F.concat(F.lit("="), F.col(item))).otherwise(fold)
    parts = groups.select(F.col(item).alias("item"), F.col(size).alias("size"), part.alias("part"))
    # at most ``most`` groups of their own and ``folds`` sums
    sums = sorted(tuple(r) for r in parts.groupBy("part").agg(F.sum("size")).collect())
    known = groups.sparkSession.createDataFrame(
        [(name, at) for (name, _), at in zip(sums, assigned([s for _, s in sums], shards), strict=True)],
        "part string, shard int",
    )
    return parts.join(F.broadcast(known), "part").select("item", "shard")


def shard(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """One row per row of ``df``: key, size (UTF-8 bytes and 1), text_crc32, shard, slot
    (0, 1, 2, ... within the shard).  Rows of equal text share a shard."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = settled(
        df.select(
            F.col(key),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(whole).alias("text_crc32"),
            F.sha2(whole, 256).alias("_group"),
        ),
        "sizes",
    )
    groups = settled(
        rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")),
        "groups",
    )
    shards_of = balanced(groups, "_group", "_bytes", shards)
    known = settled(
        groups.join(shards_of, F.col("_group") == F.col("item")).select(
            "_group", "_rows", F.col("shard").cast("int").alias("_shard")
        ),
        "shards",
    )
    found = attach(
        rows,
        known,
        "_group",
        "_rows",
        [key, "text_crc32"],
        F.col("_shard"),
        "shard",
    )
    settled_rows = settled(found.drop("_group"), "sharded")
    return ranked(settled_rows, "shard", [key, "text_crc32", "size"], "slot")
