"""Conversations that arrive row by row: redacted with the context of their group.

Every row is cut where it lies (``conversation.row_pieces``).  Its middle, which no match can
leave, is redacted in the micro-batch that brings it.  Its ends wait in the state of the
group until the neighbouring rows are there: what is kept is the joined ends that are still
open, the ends of rows that came before their turn, and the number of the next row; never
the texts of the conversation.  A timer of the group closes what is left when its last row is
``delay`` of event time old.

Every call to the state store is a message between processes, so what a group needs at each
visit is one value: it is read once and written once, whatever the number of rows.  Only rows
that wait in great number lie in entries of their own.

Pieces come out as soon as they are safe, so a row is complete when its pieces make up its
length (``assembled``).  Rows that come after their place was closed are redacted by
themselves and marked ``late``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.spans import SPAN, Pattern
from ..functions.sql import col, fn, lit, struct
from ..operators import conversation
from ..operators.redact import patterns_for
from ..policy import Policy

#: What holds the state: timers need a store of this kind.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = f"array<struct<order:bigint,piece:struct<begin:int,text:string,spans:array<{SPAN}>>>>"
_UNIT = "rows string, late boolean"
#: Rows of a group that wait in its value; more lie in entries of their own.
WAITING_ROWS = 32
#: Their characters.
WAITING_CHARS = 64_000
#: Rows of a group that are held in memory before they go to the store.
HELD_ROWS = 10_000


@dataclass
class _Row:
    """What a row leaves to its group: its ends as JSON, whether a cut lies between them, and
    whether nothing goes out over the border behind the row."""

    head: str
    tail: str | None
    cut: bool
    closed: bool

    def chars(self) -> int:
        return len(self.head) + len(self.tail or "")

    def values(self) -> list:
        return [self.head, self.tail, self.cut, self.closed]


@dataclass
class _Group:
    """What is kept of a group."""

    #: number of the next row
    following: int
    #: when the group is closed, and the timer that is set, at that time or before
    due: int = 0
    timer: int | None = None
    #: rows that wait in entries of their own
    stored: int = 0
    #: the joined ends that are still open
    opened: list[str] = field(default_factory=list)
    #: ends of rows whose turn has not come, by their number
    waiting: dict[int, _Row] = field(default_factory=dict)

    @classmethod
    def read(cls, value: str) -> _Group:
        *numbers, opened, waiting = json.loads(value)
        return cls(*numbers, opened, {order: _Row(*row) for order, *row in waiting})

    def text(self) -> str:
        waiting = [[order, *row.values()] for order, row in self.waiting.items()]
        return json.dumps([self.following, self.due, self.timer, self.stored, self.opened, waiting])

    def take(self, row: _Row) -> Iterator[str]:
        """The units that the next row closes."""
        self.opened.append(_placed(self.following, row.head))
        if row.cut or row.closed:
            yield _unit(self.opened)
            self.opened = []
        if row.tail is not None:
            self.opened.append(_placed(self.following, row.tail))
        self.following += 1


def _placed(order: int, piece: str) -> str:
    return f'{{"order":{order},"piece":{piece}}}'


def _unit(pieces: Sequence[str]) -> str:
    return f"[{','.join(pieces)}]"


class _Ends(StatefulProcessor):
    """Puts the ends of a group's rows together in their order."""

    def __init__(self, keys: Sequence[str], order: str, delay_ms: int, first: int):
        self.order, self.delay_ms, self.first = order, delay_ms, first
        self.row = Row(*keys, "rows", "late")

    def init(self, handle) -> None:
        self.handle = handle
        number = StructType([StructField("value", LongType())])
        text = StructType([StructField("value", StringType())])
        self.group = handle.getValueState("group", text)
        self.waiting = handle.getMapState("waiting", number, text)

    def _read(self) -> _Group:
        stored = self.group.get()
        return _Group(self.first) if stored is None else _Group.read(stored[0])

    def _waits(self, group: _Group, order: int) -> bool:
        return order in group.waiting or (group.stored > 0 and self.waiting.containsKey((order,)))

    def _waited(self, group: _Group, order: int) -> _Row | None:
        """The row of this number if it waits, which it then no longer does."""
        if order in group.waiting or not group.stored:
            return group.waiting.pop(order, None)
        value = self.waiting.getValue((order,))
        if value is None:
            return None
        self.waiting.removeKey((order,))
        group.stored -= 1
        return _Row(*json.loads(value[0]))

    def _store(self, group: _Group) -> None:
        """Leaves the next rows to the group's value, within the bounds, and stores the others."""
        rows, chars = WAITING_ROWS, WAITING_CHARS
        for order in sorted(group.waiting):
            rows, chars = rows - 1, chars - group.waiting[order].chars()
            if rows < 0 or chars < 0:
                row = group.waiting.pop(order)
                self.waiting.updateValue((order,), (json.dumps(row.values()),))
                group.stored += 1

    def handleInputRows(self, key, rows, timerValues):
        group = self._read()
        newest = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            order = r[self.order]
            newest = max(newest, r["event_ms"])
            row = _Row(r["head"], r["tail"], r["middle"] is not None, r["closed"])
            late = order < group.following or self._waits(group, order)
            if row.cut:
                yield self.row(*key, _unit([_placed(order, r["middle"])]), late)
            if late:
                for end in (row.head, row.tail):
                    if end is not None:
                        yield self.row(*key, _unit([_placed(order, end)]), True)
                continue
            group.waiting[order] = row
            if len(group.waiting) >= HELD_ROWS:
                yield from self._drained(key, group)
                self._store(group)
        yield from self._drained(key, group)
        self._store(group)
        # a timer that is set stays; if it fires before the group is due, it is set again
        group.due = max(group.due, newest + self.delay_ms)
        if group.timer is None:
            group.timer = group.due
            self.handle.registerTimer(group.timer)
        self.group.update((group.text(),))

    def _drained(self, key, group: _Group) -> Iterator[Row]:
        while (row := self._waited(group, group.following)) is not None:
            for unit in group.take(row):
                yield self.row(*key, unit, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        group = self._read()
        if group.due > timerValues.getCurrentWatermarkInMs():
            group.timer = group.due
            self.handle.registerTimer(group.timer)
        else:
            stored = [k[0] for k in self.waiting.keys()] if group.stored else []
            for order in sorted([*group.waiting, *stored]):
                group.following = order
                for unit in group.take(self._waited(group, order)):
                    yield self.row(*key, unit, False)
            if group.opened:
                yield self.row(*key, _unit(group.opened), False)
            group = _Group(group.following)
        self.group.update((group.text(),))

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Names the state store that timers need in the session's settings."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def redact_conversations(
    stream: DataFrame,
    policy: Policy,
    keys: Sequence[str],
    order: str,
    event_time: str,
    delay: str = "10 minutes",
    text: str = "text",
    separator: str = "\n",
    dictionaries: Sequence[Pattern] = (),
    first: int = 0,
) -> DataFrame:
    """Pieces of rows (keys, order, begin, n_chars, size, redacted, spans, late) of a stream
    with consecutive ``order`` from ``first`` in each group.

    The watermark of the stream must be set on ``event_time``.  Offsets of spans index the
    row.  Patterns whose reach cannot be told are refused: they would keep whole groups.
    """
    policy.validate()
    keys = list(keys)
    patterns = patterns_for(policy, dictionaries)
    across = conversation.crossing(patterns, policy, separator)
    if across is None:
        raise ValueError("the policy needs whole groups, which a stream does not keep")
    own = [p for p in patterns if p not in across]
    # the event time rides along as a key: a projection, nothing is grouped by it here
    pieces = conversation.row_pieces(stream, [*keys, event_time], order, text, own, across, separator)
    ends = pieces.select(
        *keys,
        event_time,
        F.col(order).cast("bigint").alias(order),
        *[F.to_json(f"_{name}").alias(name) for name in ("head", "middle", "tail")],
        F.col("_closed").alias("closed"),
        F.unix_millis(event_time).alias("event_ms"),
    )
    seconds = stream.sparkSession.sql(f"SELECT CAST(INTERVAL {delay} AS INTERVAL SECOND) AS s").first().s
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema if f.name in keys]
    units = ends.groupBy(*keys).transformWithState(
        _Ends(keys, order, int(seconds.total_seconds() * 1000), first),
        ", ".join([*kinds, _UNIT]),
        "Append",
        "EventTime",
    )
    known = fn.transform(
        fn.from_json(col("rows"), lit(_ROWS)),
        lambda r: struct(
            ord=struct(order=r["order"], begin=r["piece"]["begin"]),
            text=r["piece"]["text"],
            spans=r["piece"]["spans"],
        ),
    )
    document = fn.concat_ws("|", *[col(k).cast("string") for k in keys])
    lines = conversation.searched(
        units.select(*keys, "late", known.column().alias("_rows")),
        [*keys, "late"],
        policy,
        across,
        separator,
        document,
    )
    done = conversation.finish_rows(lines)
    moved = fn.transform(
        col("spans"),
        lambda s: struct(
            start=s["start"] + col("_at.begin"),
            end=s["end"] + col("_at.begin"),
            label=s["label"],
            text=s["text"],
            new_text=s["new_text"],
        ),
    )
    return done.select(
        *keys,
        F.col("_at.order").alias(order),
        F.col("_at.begin").alias("begin"),
        F.length("original_text").alias("n_chars"),
        F.col("redacted_text").alias("redacted"),
        moved.column().alias("spans"),
        "late",
    )


def assembled(pieces: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows (keys, order, n_chars, redacted_text, spans) from their stored pieces; a row is
    complete when ``n_chars`` is its length."""
    piece = F.struct("begin", "n_chars", "redacted", "spans")
    return (
        pieces.groupBy(*keys, order)
        .agg(F.sum("n_chars").alias("n_chars"), F.array_sort(F.collect_list(piece)).alias("_p"))
        .select(
            *keys,
            order,
            "n_chars",
            F.array_join("_p.redacted", "").alias("redacted_text"),
            F.flatten("_p.spans").alias("spans"),
        )
    )
