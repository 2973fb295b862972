"""Repair of the turn structure of conversations at the least cost.

Every row of a conversation is kept, given the role user or assistant, or deleted, and
empty turns may be inserted anywhere, so that the initials of the roles read
``(s?(ua)+)?``.  Of the cheapest ways the one whose audit (initials of the edits: D, I, K,
R) is least in ASCII order is taken.

A way is one integer.  Its high digits are the cost; below lie ``SLOT`` digits of ``BITS``
bits for each row: the letters of the inserts before the row and of its own edit, zeros
behind.  A slot ends in a letter that is no insert, so no slot is the beginning of another
one, and comparing integers compares cost first and then audits.  Weights just add up, and
an ordinary minimum over a DAG of four states (start, s, u, a) per row decides everything.

Rows carry no text through this: their keys, roles, marks and a checksum are sorted over
all machines, and a task turns each run of rows of one conversation into a table of its best
ways from state to state, ``BLOCK`` rows at a time, so that integers stay short.  The
tables of a conversation are joined up the same way, with the rank of a way among those
from the same state as its digit; a conversation has one such table per sorted partition
that it reaches.  At last the rows with their texts meet the audit, sorted by conversation,
and are hashed as they pass by; only one audit and one Arrow batch are held.  SHA-256 of a
conversation cannot be split: its rows pass through one task, as a stream.

Results for special rows: a null role or text is one blank, so a null text is a blank row;
null conv_ids are one conversation; null turns come first; rows of one turn go by role, then
by the SHA-256 of role and text; rows equal in all are copies, the later ones duplicates; an
empty role has no initial and cannot be kept; a conversation without rows has zeros, an
empty audit and the hash of the empty string; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import attach, bound_batches, settled

#: Letters of edits in ASCII order; a letter's digit is its place from 1.
LETTERS = "DIKR"
BITS, SLOT = 3, 3
#: Rows per table of ways that are added up in one integer.
BLOCK = 256
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after the next user or assistant turn.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: States by the initial of a role.
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LAWFUL = frozenset([(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)])
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: What a blank text consists of, and what a text may end in behind its last character.
SPACES = " \t\n\v\f\r"

Way = tuple[int, str]  # cost, letters
Table = dict[tuple[int, int], Way]


def digits(letters: str) -> int:
    """Letters as the high digits of a slot, zeros behind."""
    value = 0
    for letter in letters.ljust(SLOT, "\0"):
        value = value << BITS | (LETTERS.index(letter) + 1 if letter != "\0" else 0)
    return value


def _edits(state: int, initial: int, gone: bool, cut: bool) -> Iterator[tuple[int, int, str]]:
    """(state after, cost, letters) of all ways to pass one row."""
    cost, letters = 0, ""
    for _ in range(SLOT):  # a third insert would only come back to an earlier state
        yield state, cost + DELETE, letters + "D"
        if not gone:
            rest = CUT if cut else 0
            if (initial == SYSTEM and state == START) or (initial != SYSTEM and initial == NEXT[state]):
                yield initial, cost + KEEP + rest, letters + "K"
            yield NEXT[state], cost + REROLE + rest, letters + "R"
        state, cost, letters = NEXT[state], cost + INSERT, letters + "I"


def _row_table(initial: int, gone: bool, cut: bool) -> list[tuple[int, int, int, int]]:
    """(state, state after, cost, digits): the best way of each pair for one row."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in STATES:
        for after, cost, letters in _edits(state, initial, gone, cut):
            way = (cost, digits(letters))
            if (state, after) not in best or way < best[state, after]:
                best[state, after] = way
    return [(a, b, cost, slot) for (a, b), (cost, slot) in best.items()]


ROWS = {
    (initial, gone, cut): _row_table(initial, gone, cut)
    for initial in (-1, SYSTEM, USER, ASSISTANT)
    for gone in (False, True)
    for cut in (False, True)
}
#: Cost and letters of the inserts behind the last row, by the state it leaves.
ENDING = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}


def block_table(rows: list[tuple[int, bool, bool]]) -> Table:
    """Best ways through up to ``BLOCK`` rows (initial, must go, cut off) between states."""
    width = BITS * SLOT
    low = width * len(rows)
    table: Table = {}
    for begin in STATES:
        now: dict[int, int] = {begin: 0}
        place = low
        for row in rows:
            place -= width
            then: dict[int, int] = {}
            for state, after, cost, slot in ROWS[row]:
                if state in now:
                    way = now[state] + (cost << low) + (slot << place)
                    if after not in then or way < then[after]:
                        then[after] = way
            now = then
        for after, way in now.items():
            table[begin, after] = (way >> low, _letters(way, len(rows)))
    return table


def _letters(way: int, n_rows: int) -> str:
    """The audit in the low digits of a way."""
    mask = (1 << BITS) - 1
    found = [way >> BITS * at & mask for at in range(SLOT * n_rows - 1, -1, -1)]
    return "".join(LETTERS[d - 1] for d in found if d)


def joined(tables: list[Table]) -> Table:
    """Best ways through tables that follow each other, ``BLOCK`` at a time."""
    while len(tables) > 1:
        tables = [_joined(tables[i : i + BLOCK]) for i in range(0, len(tables), BLOCK)]
    return tables[0]


def _joined(tables: list[Table]) -> Table:
    width = 2  # a way is one of four from its state
    low = width * len(tables)
    ranks = []
    for table in tables:
        order: dict[tuple[int, int], int] = {}
        for state in STATES:
            ends = sorted((way[1], after) for (begin, after), way in table.items() if begin == state)
            order.update({(state, after): rank for rank, (_, after) in enumerate(ends)})
        ranks.append(order)
    found: Table = {}
    for begin in STATES:
        now: dict[int, int] = {begin: 0}
        paths: dict[int, tuple] = {begin: ()}
        place = low
        for table, order in zip(tables, ranks, strict=True):
            place -= width
            then: dict[int, int] = {}
            back: dict[int, tuple] = {}
            for (state, after), (cost, _) in table.items():
                if state in now:
                    way = now[state] + (cost << low) + (order[state, after] << place)
                    if after not in then or way < then[after]:
                        then[after], back[after] = way, (paths[state], (state, after))
            now, paths = then, back
        for after, way in now.items():
            steps, path = [], paths[after]
            while path:
                path, step = path
                steps.append(step)
            letters = "".join(t[s][1] for t, s in zip(tables, reversed(steps), strict=True))
            found[begin, after] = (way >> low, letters)
    return found


def best_of(table: Table) -> Way:
    """The cheapest whole way from the start, inserts at the end included; of these the one
    with the least audit."""
    ways = []
    for (begin, after), (cost, letters) in table.items():
        if begin == START:
            ways.append((cost + ENDING[after][0], letters + ENDING[after][1]))
    return min(ways)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The rows (role, text) after the edits of ``audit``."""
    state = START
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield ROLE_OF[state], ""
            continue
        role, text = next(rows)
        if letter == "K":
            state = INITIAL[role[0]]
            yield role, text
        elif letter == "R":
            state = NEXT[state]
            yield ROLE_OF[state], text


# --- rows --------------------------------------------------------------------------------


def plain_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, n): the rows under own names, each once."""
    return df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.lit(1).alias("n"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the damage told by the checksum of conversation and turn: 0 drops a
    row (``n`` is 0), 1 empties its text, 2 takes its sentence ends, 3 repeats it (``n`` is
    2), 4 makes its role user."""
    blank = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv").cast("string"), blank),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), blank),
    )
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    return rows.select(
        "conv",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "")
        .when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(F.col("n")).alias("n"),
    )


def _checksum(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of values, their lengths with them."""
    named = [x for p in parts for x in (F.coalesce(F.length(p).cast("string"), F.lit("-")), p)]
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", *named), 256), 1, 32))


def _light(rows: DataFrame) -> DataFrame:
    """The rows without their texts: marks, and checksums to tell equal ones."""
    ends = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    return rows.select(
        "conv",
        "turn",
        "role",
        _checksum(F.col("role"), F.col("text")).alias("same"),
        _checksum(F.col("conv").cast("string"), F.col("role"), F.col("text")).alias("key"),
        F.when(ends == "", BLANK).when(~ends.isin(".", "!", "?"), TRUNCATED).otherwise(0).alias("mark"),
        "n",
    )


def _late(light: DataFrame) -> DataFrame:
    """The light rows plus ``late``: an equal role and text stands in an earlier turn."""
    there = light.where("n > 0")
    null = F.col("turn").isNull()
    repeats = settled(
        there.groupBy("key")
        .agg(F.max(null).alias("nulls"), F.min("turn").alias("first"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1"),
        "repeats",
    )
    met = attach(
        light, repeats, "key", "rows", ["conv", "turn"], F.struct("nulls", "first"), "earlier"
    )
    late = ~null & (F.col("earlier.nulls") | (F.col("turn") > F.col("earlier.first")))
    return met.select(
        "conv", "turn", "role", "same", "mark", "n", F.coalesce(late, F.lit(False)).alias("late")
    )


# --- runs: what a sorted partition holds of a conversation ---------------------------------

_PAIRS = [(a, b) for a in STATES for b in STATES]
RUN = (
    "conv {conv}, part int, n_rows long, blank long, duplicate long, truncated long, illegal long, "
    "turns long, first_turn {turn}, last_turn {turn}, first_initial int, last_initial int, "
    "costs array<long>, letters array<string>"
)


class _Run:
    """Counts and ways of consecutive rows of one conversation."""

    def __init__(self, conv):
        self.conv, self.counts = conv, [0, 0, 0, 0]
        self.n_rows = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.initials: list[int] = []  # the first and the last
        self.rows: list[tuple[int, bool, bool]] = []
        self.tables: list[Table] = []
        self.before = None

    def add(self, turn, role, same, mark, n, late) -> None:
        if turn is not None and n:
            if turn != self.last_turn:
                self.turns += 1
            if self.first_turn is None:
                self.first_turn = turn
            self.last_turn = turn
        name = (turn, same)
        state = INITIAL.get(role[:1], -1)
        for _ in range(n):
            fault = mark
            if mark != BLANK and (late or self.before == name):
                fault = DUPLICATE
            self.before = name
            self.counts[fault] += 1
            self.n_rows += 1
            if self.initials:
                self.illegal += (self.initials[-1], state) not in LAWFUL
                self.initials[1:] = [state]
            else:
                self.initials = [state]
            self.rows.append((state, fault in (BLANK, DUPLICATE), fault == TRUNCATED))
            if len(self.rows) == BLOCK:
                self.tables.append(block_table(self.rows))
                self.rows = []

    def result(self, part: int) -> tuple:
        if self.rows:
            self.tables.append(block_table(self.rows))
        table = joined(self.tables) if self.tables else {(s, s): (0, "") for s in STATES}
        first, last = (self.initials[0], self.initials[-1]) if self.initials else (None, None)
        return (
            self.conv, part, self.n_rows, *self.counts[1:], self.illegal, self.turns,
            self.first_turn, self.last_turn, first, last,
            [table.get(p, (-1, ""))[0] for p in _PAIRS],
            [table.get(p, (-1, ""))[1] for p in _PAIRS],
        )


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _runs(schema: pa.Schema):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for conv, *row in _rows(batch, ["conv", "turn", "role", "same", "mark", "n", "late"]):
                if run is None or run.conv != conv:
                    if run is not None:
                        out.append(run.result(part))
                    run = _Run(conv)
                run.add(*row)
            yield _table(out, schema)
        if run is not None:
            yield _table([run.result(part)], schema)

    return found


DECISION = (
    "conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string"
)


def _decided(conv, runs: list[tuple]) -> tuple:
    """One conversation from its runs in order."""
    counts = [sum(r[i] for r in runs) for i in (3, 4, 5, 6)]
    filled = [r for r in runs if r[2]]
    counts[3] += sum((a[11], b[10]) not in LAWFUL for a, b in pairwise(filled))
    turned = [r for r in runs if r[8] is not None]
    turns = sum(r[7] for r in turned) - sum(a[9] == b[8] for a, b in pairwise(turned))
    gaps = turned[-1][9] - turned[0][8] + 1 - turns if turned else 0
    tables = [
        {p: (int(c), w) for p, c, w in zip(_PAIRS, r[12], r[13], strict=True) if c >= 0} for r in filled
    ]
    cost, audit = best_of(joined(tables)) if tables else (0, "")
    return (conv, gaps, *counts, cost, audit)


def _decisions(schema: pa.Schema):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple] = []
        for batch in batches:
            out = []
            for row in _rows(batch, batch.schema.names):
                if runs and runs[0][0] != row[0]:
                    out.append(_decided(runs[0][0], runs))
                    runs = []
                runs.append(row)
            yield _table(out, schema)
        if runs:
            yield _table([_decided(runs[0][0], runs)], schema)

    return found


def decisions(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, n): counts of faults,
    cost and audit."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    bound_batches()
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "same"]
    ordered = _late(_light(rows)).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = RUN.format(**kinds)
    runs = settled(ordered.mapInArrow(_runs(_arrow(schema)), schema), "runs")
    schema = DECISION.format(**kinds)
    # a conversation has a row per partition that it reaches, at most
    grouped = runs.repartition("conv").sortWithinPartitions("conv", "part")
    return grouped.mapInArrow(_decisions(_arrow(schema)), schema)


# --- texts -------------------------------------------------------------------------------


def _hashes(schema: pa.Schema):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in _rows(batch, ["head", "role", "text", "n"]))
        head = next(stream, (None,))[0]
        following = None

        def mine() -> Iterator[tuple[str, str]]:
            """The rows up to the next conversation's head, repeated ones twice."""
            nonlocal following
            for row in stream:
                if row[0] is not None:
                    following = row[0]
                    return
                for _ in range(row[3]):
                    yield row[1], row[2]
            following = None

        out, size = [], 0
        while head is not None:
            rows, digest, mark = mine(), hashlib.sha256(), ""
            for role, text in repaired(head["audit"], rows):
                digest.update(f"{mark}{role}:{text}".encode())
                mark = "\n"
            for _ in rows:
                raise RuntimeError("a conversation has more rows than its audit")
            out.append((*[head[c] for c in schema.names[:-1]], digest.hexdigest()))
            size += len(head["audit"]) + 200
            if size > 1_000_000:
                yield _table(out, schema)
                out, size = [], 0
            head = following
        yield _table(out, schema)

    return found


def repair(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    damage: bool = False,
) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.  With ``damage`` the rows are damaged first (a test of repair);
    conversations that lose all rows stay, without rows."""
    rows = plain_rows(df, conv, turn, role, text)
    if damage:
        rows = damaged(rows)
    decided = settled(decisions(rows), "decisions")
    fields = decided.columns
    heads = decided.select(
        "conv",
        F.lit(0).alias("behind"),
        F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("same"),
        F.lit(None).cast("string").alias("text"),
        F.lit(0).alias("n"),
        F.struct(*fields).alias("head"),
    )
    texts = rows.where("n > 0").select(
        "conv",
        F.lit(1).alias("behind"),
        "turn",
        "role",
        _checksum(F.col("role"), F.col("text")).alias("same"),
        "text",
        "n",
        F.lit(None).cast(heads.schema["head"].dataType).alias("head"),
    )
    order = ["conv", "behind", F.col("turn").asc_nulls_first(), "role", "same"]
    ordered = heads.unionByName(texts).repartition("conv").sortWithinPartitions(*order)
    schema = DECISION.format(conv=rows.schema["conv"].dataType.simpleString()) + ", repaired_sha256 string"
    return ordered.mapInArrow(_hashes(_arrow(schema)), schema).withColumnRenamed("conv", conv)
