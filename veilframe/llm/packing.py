"""Best-fit packing, planned over counts of lengths.

Only the number of pieces of each length goes to the driver: at most ``size`` numbers,
however many documents there are.  Best-fit decreasing runs over these counts: a length
goes, as many at once as fit, to the sequences with the least room that still hold it.
Sequences filled alike are one line of the plan, which therefore has a few lines per
length.  The documents then take the planned slots: a piece's rank among the pieces of its
length is its slot, and the plan says where that slot lies.

Results for special rows: a null text counts as empty and is one piece, the end id; equal
rows take slots of their own; an empty table gives an empty table; other columns are not
carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_encoder
from .common import bound_batches, ranked, settled, slices

SIZE = 1024

#: (length, first slot, slots, first sequence, sequences, offset of the first in its sequence)
Line = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], size: int = SIZE) -> list[Line]:
    """Places for ``counts[length]`` pieces of every length, few sequences in all.

    Slot ``s`` of a line lies in sequence ``first + (s - first slot) % sequences``, at
    ``offset + length * ((s - first slot) // sequences)``.
    """
    rooms: list[int] = []  # with sequences, ascending
    groups: dict[int, list[tuple[int, tuple]]] = {}  # room: (sequences, ((length, times), ...))

    def put(room: int, n: int, filled: tuple) -> None:
        if not n:
            return
        if room not in groups:
            rooms.insert(bisect_left(rooms, room), room)
            groups[room] = []
        groups[room].append((n, filled))

    def take(room: int) -> tuple[int, tuple]:
        group = groups[room].pop()
        if not groups[room]:
            del groups[room]
            rooms.pop(bisect_left(rooms, room))
        return group

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                n, filled = take(room)
            else:
                room, filled = size, ()
                n = -(-left // (size // length))
            times = room // length
            whole = min(n, left // times)
            put(room - times * length, whole, (*filled, (length, times)) if whole else filled)
            left -= whole * times
            n -= whole
            if n and left and left < times:
                put(room - left * length, 1, (*filled, (length, left)))
                left, n = 0, n - 1
            put(room, n, filled)
    lines: list[Line] = []
    used: dict[int, int] = dict.fromkeys(counts, 0)
    first = 0
    for room in rooms:
        for n, filled in groups[room]:
            offset = 0
            for length, times in filled:
                lines.append((length, used[length], n * times, first, n, offset))
                used[length] += n * times
                offset += length * times
            first += n
    return lines


def placed(pieces: DataFrame, length: str, order: list[str], size: int = SIZE) -> DataFrame:
    """``pieces`` plus sequence_id and offset; ``length`` is from 1 to ``size``, ``order``
    tells pieces of one length apart."""
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # <= size rows
    lines = sorted(plan(counts, size))
    table = np.array(lines, np.int64).reshape(-1, 6)
    # one ascending number for (length, slot): searched once for both
    wide = int(table[:, 2].sum()) + 1
    starts = table[:, 0] * wide + table[:, 1]
    sent = pieces.sparkSession.sparkContext.broadcast((starts, table, wide))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(lengths: pa.Array, slots: pa.Array) -> pa.Array:
        starts, table, wide = sent.value
        n, slot = lengths.to_numpy().astype(np.int64), slots.to_numpy()
        line = table[np.searchsorted(starts, n * wide + slot, side="right") - 1]
        within = slot - line[:, 1]
        return pa.StructArray.from_arrays(
            [
                pa.array(line[:, 3] + within % line[:, 4], pa.int64()),
                pa.array(line[:, 5] + n * (within // line[:, 4]), pa.int64()),
            ],
            ["sequence_id", "offset"],
        )

    found = ranked(pieces, length, order, "_slot").withColumn("_at", place(length, "_slot"))
    return found.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def cuts(text: Column, path: str, end_id: int, size: int, keep_ids: bool) -> Column:
    """Pieces of a text's ids as an array of (length, ids_crc32, ids); ids only if asked."""
    kind = f"array<struct<length: long, ids_crc32: long{', ids: binary' * keep_ids}>>"
    names = ["length", "ids_crc32", "ids"][: 2 + keep_ids]

    bound_batches()

    @F.arrow_udf(kind)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = word_encoder.encoder(path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            stops: list[int] = [0]
            lengths: list[int] = []
            sums: list[int] = []
            kept: list[bytes] = []
            for texts in slices(batch):
                for raw in encoder.encode(texts):
                    raw += tail
                    # the first piece takes what is left over
                    first = (len(raw) - 4) % (4 * size) + 4
                    for begin, stop in pairwise([0, *range(first, len(raw) + 1, 4 * size)]):
                        part = raw[begin:stop]
                        lengths.append(len(part) >> 2)
                        sums.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(part)
                    stops.append(len(lengths))
            columns = [
                pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()),
                pa.array(kept, pa.binary()),
            ][: len(names)]
            yield pa.ListArray.from_arrays(
                pa.array(stops, pa.int32()), pa.StructArray.from_arrays(columns, names)
            )

    return cut(text)


def pack(
    df: DataFrame,
    path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces (key, piece, start, length, ids_crc32, sequence_id, offset) of all texts, and
    their ids (little-endian unsigned 32-bit) if ``keep_ids``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = df.select(F.col(key), cuts(whole, path, end_id, size, keep_ids).alias("_cuts"))
    first = F.col("_cuts")[0]["length"]
    # no array is empty; the outer form keeps Spark from asking so beforehand, which would
    # encode every text a second time
    each = F.posexplode_outer("_cuts").alias("piece", "_cut")
    pieces = cut.select(key, first.alias("_first"), each).select(
        key,
        "piece",
        F.when(F.col("piece") == 0, F.lit(0))
        .otherwise(F.col("_first") + (F.col("piece") - 1) * F.lit(size))
        .cast("long")
        .alias("start"),
        "_cut.*",
    )
    return placed(settled(pieces, "pieces"), "length", [key, "piece", "ids_crc32"], size)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces packed with their ids; a sequence holds at most
    ``size`` ids, so gathering one is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda got, p: F.concat(got, p["ids"]))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), joined.alias("ids")
    )
