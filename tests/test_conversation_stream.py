"""A stream of conversation rows against the batch result."""

from __future__ import annotations

import json
import random
import tempfile
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from registry import texts
from veilframe import session
from veilframe.operators import conversation
from veilframe.policy import Policy
from veilframe.streaming import conversations

PATTERN = r"[A-Za-zÀ-ÿ]+[.]\n[A-ZÀ-Þ][a-zà-ÿ]+"
POLICY = Policy(
    default="Off", config={"LAW": "Redaction", "NRP": "Redaction"}, claim_off=False, seed=7,
    allow={"LAW": [PATTERN, r"(?i)ann\s+lee"], "NRP": [r"[A-Z][a-z]+tion"]},
)
SCHEMA = "conv_id long, turn long, text string, ts timestamp"


def run(spark, batches, delay="5 minutes"):
    """Pieces that come out of the batches, one micro-batch each."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    conversations.use_state_store(spark)
    folder = tempfile.mkdtemp(prefix="veilframe-stream-")
    try:
        for at, rows in enumerate(batches):
            rows.coalesce(1).write.mode("append").parquet(f"{folder}/in/{at:03}")
        source = (
            spark.readStream.schema(batches[0].schema)
            .option("maxFilesPerTrigger", 1)
            .parquet(f"{folder}/in/*")
            .withWatermark("ts", "1 minute")
        )
        out = conversations.redact_conversations(source, POLICY, ["conv_id"], "turn", "ts", delay)
        query = (
            out.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        assert query.awaitTermination(300) and query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/out").where("conv_id IS NOT NULL")


def end(spark):
    """A row that moves the watermark beyond all others."""
    return spark.sql("SELECT CAST(null AS bigint) AS conv_id, 0L AS turn, '' AS text, timestamp'2024-06-01 00:00:00' AS ts")


def batch(spark, rows):
    done = conversation.redact_rows(rows.select("conv_id", "turn", "text"), POLICY, ["conv_id"], "turn")
    return {
        (r["conv_id"], r["turn"]): (r["redacted_text"], [(s["start"], s["end"], s["label"], s["new_text"]) for s in r["spans"]])
        for r in done.collect()
    }


def streamed(pieces):
    return {
        (r["conv_id"], r["turn"]): (r["redacted_text"], [(s["start"], s["end"], s["label"], s["new_text"]) for s in r["spans"]])
        for r in conversations.assembled(pieces, ["conv_id"], "turn").collect()
    }


def test_shuffled_rows_equal_the_batch(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("turn"))
    )
    part = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    pieces = run(spark, [*[rows.where(part == i) for i in range(4)], end(spark)])
    assert not pieces.where("late").count()
    want = batch(spark, rows)
    assert streamed(pieces) == want
    assert sum(s[2] == "LAW" for _, spans in want.values() for s in spans) > 50


def test_gaps_late_rows_and_single_words(spark):
    def rows(*given):
        return spark.createDataFrame(
            [(c, t, x, __import__("datetime").datetime(2024, 1, 1, 0, minute)) for c, t, x, minute in given], SCHEMA
        )

    batches = [
        rows((1, 2, "ann", 0), (2, 1, "Done.", 0), (1, 0, "I met ann", 0)),
        rows((1, 1, "lee", 1), (1, 3, "lee and Action", 1), (2, 3, "More to say", 1)),
        rows((3, 0, "x", 30)),  # moves the watermark beyond the groups of the first batches
        rows((3, 1, "y", 30)),  # closes them
        rows((2, 2, "Late row. Ann Lee", 31), (3, 2, "z", 31)),
        end(spark),
    ]
    pieces = run(spark, batches)
    found = streamed(pieces)
    late = {(r["conv_id"], r["turn"]) for r in pieces.where("late").collect()}
    assert late == {(2, 2)}
    known = batch(spark, rows((1, 0, "I met ann", 0), (1, 1, "lee", 0), (1, 2, "ann", 0), (1, 3, "lee and Action", 0)))
    assert {k: v for k, v in found.items() if k[0] == 1} == known
    assert [s[2] for s in found[1, 0][1]] == ["LAW"] and len(found[1, 3][1]) == 2
    # turns 1 and 3 were joined over the gap when the group was closed
    assert [s[2] for s in found[2, 1][1]] == ["LAW"] and [s[2] for s in found[2, 3][1]] == ["LAW"]
    assert [s[2] for s in found[2, 2][1]] == ["LAW"]


def test_patterns_that_need_whole_groups_are_refused(spark):
    policy = Policy(default="Off", config={"LAW": "Redaction"}, allow={"LAW": [r"a(?=\nb)"]}, claim_off=False)
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="whole groups"):
        conversations.redact_conversations(df, policy, ["conv_id"], "turn", "ts")


class Store:
    """A state store in memory that counts the calls: in a job each is a message."""

    def __init__(self):
        self.calls, self.value, self.entries, self.timers = Counter(), None, {}, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getMapState(self, name, key, schema):  # noqa: N802
        return Entries(self)

    def get(self):
        self.calls["get"] += 1
        return self.value

    def update(self, value):
        self.calls["update"] += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.append(at)


class Entries:
    def __init__(self, store):
        self.store = store

    def call(self, do, *given):
        self.store.calls["entries"] += 1
        return do(*given)

    def containsKey(self, key):  # noqa: N802
        return self.call(self.store.entries.__contains__, key)

    def getValue(self, key):  # noqa: N802
        return self.call(self.store.entries.get, key)

    def updateValue(self, key, value):  # noqa: N802
        self.call(self.store.entries.__setitem__, key, value)

    def removeKey(self, key):  # noqa: N802
        self.call(self.store.entries.pop, key)

    def keys(self):
        return self.call(lambda: list(self.store.entries))


class Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


def processor(store):
    ends = conversations._Ends(["g"], "n", 100, 0)
    ends.init(store)
    return ends


def visit(ends, numbers, watermark=0):
    """Rows of one word each, whose ends are open to both sides and meet their neighbours."""
    rows = [
        Row(g="a", n=n, event_ms=n, head=f'{{"text":"h{n}"}}', middle=f'{{"text":"m{n}"}}', tail=f'{{"text":"t{n}"}}', closed=False)
        for n in numbers
    ]
    return shown(ends.handleInputRows(("a",), iter(rows), Times(watermark)))


def shown(units):
    return [(" ".join(p["piece"]["text"] for p in json.loads(u.rows)), u.late) for u in units]


def test_a_visit_reads_and_writes_one_value():
    store = Store()
    ends = processor(store)
    found = visit(ends, [5, 1]) + visit(ends, [3, 0]) + visit(ends, [7, 2]) + visit(ends, [4, 6])
    assert sorted(found) == sorted(
        [("h0", False), *[(f"t{n} h{n + 1}", False) for n in range(7)], *[(f"m{n}", False) for n in range(8)]]
    )
    assert store.calls == {"get": 4, "update": 4, "timer": 1}


@pytest.mark.parametrize("held", [10_000, 40])
def test_rows_that_wait_in_great_number(monkeypatch, held):
    monkeypatch.setattr(conversations, "HELD_ROWS", held)
    store = Store()
    ends = processor(store)
    numbers = [n for n in range(300) if n not in (0, 200)]
    random.Random(7).shuffle(numbers)
    found = visit(ends, numbers)
    assert len(store.entries) == len(numbers) - conversations.WAITING_ROWS
    assert len(json.loads(store.value[0])[-1]) == conversations.WAITING_ROWS
    assert visit(ends, [250, 0, 0])[:3] == [("m250", True), ("h250", True), ("t250", True)]
    assert json.loads(store.value[0])[0] == 200  # the next row
    assert len(store.entries) + len(json.loads(store.value[0])[-1]) == 99
    due = json.loads(store.value[0])[1]
    found += shown(ends.handleExpiredTimer(("a",), Times(due), None))
    # over the gap the ends are joined when the group is closed
    assert ("t199 h201", False) in found and ("t299", False) in found
    assert not store.entries and json.loads(store.value[0])[3:] == [0, [], []]
    assert visit(ends, [200], due) == [("m200", True), ("h200", True), ("t200", True)]


def test_a_timer_that_fires_early_is_set_again():
    store = Store()
    ends = processor(store)
    visit(ends, [0])
    visit(ends, [50])
    visit(ends, [2])  # older than the last row: the group stays open for that
    assert store.timers == [100]
    assert not shown(ends.handleExpiredTimer(("a",), Times(120), None)) and store.timers == [100, 150]
    assert shown(ends.handleExpiredTimer(("a",), Times(150), None)) == [("t0 h2", False), ("t2 h50", False), ("t50", False)]
    visit(ends, [51], 150)
    assert store.timers == [100, 150, 250]


def test_a_long_conversation_in_shuffled_batches(spark):
    said = F.when(F.col("id") % 2 == 1, "lee Done.").when(F.col("id") % 3 == 0, "Said ann and more").otherwise("Said ann")
    rows = spark.range(180).select(
        F.lit(2**53 + 1).alias("conv_id"),
        F.col("id").alias("turn"),
        said.alias("text"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
    )
    part = F.pmod(F.xxhash64("turn"), F.lit(3))
    pieces = run(spark, [*[rows.where(part == i) for i in range(3)], end(spark)])
    assert not pieces.where("late").count()
    want = batch(spark, rows)
    assert streamed(pieces) == want and sum(len(spans) for _, spans in want.values()) > 100


def test_micro_batches_of_the_query_are_files_of_bounded_rows(spark, sf_dir, monkeypatch):
    folder = Path(session.checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("veilframe-stream-*"))
    monkeypatch.setattr(texts, "_STREAM_ROWS", 8)
    done = texts.stream_conversations(spark, sf_dir)
    assert done.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    (used,) = set(folder.glob("veilframe-stream-*")) - before
    log = [line for f in (used / "checkpoint/sources/0").iterdir() if f.name.isdigit() for line in f.read_text().splitlines()[1:]]
    read = Counter(json.loads(line)["batchId"] for line in log)
    assert [read[at] for at in sorted(read)] == [3, 3, 3, 3, 1]
