"""Toxicity: segments against brute force, held-out accuracy, special rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tests.llm.data import CLASHING, ROWS, clashing, docs
from veilframe.llm import queries, toxicity


def maximal(scores):
    """All maximal segments by their definition: no part has a lower or equal beginning sum
    or a higher end sum inside, taken greatest first, split to both sides."""

    def split(begin, end):
        best = None
        for i in range(begin, end):
            total = 0
            for j in range(i, end):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] or (total == best[0] and j + 1 - i < best[2] - best[1])):
                    best = (total, i, j + 1)
        if best is None:
            return []
        return [*split(begin, best[1]), (best[1], best[2], best[0]), *split(best[2], end)]

    return split(0, len(scores))


def test_segments_are_the_maximal_ones():
    draw = random.Random(3)
    for _ in range(400):
        scores = [draw.choice([-3, -2, -1, 1, 2, 4]) * 1.0 for _ in range(draw.randrange(1, 25))]
        found = toxicity.segments(np.array(scores))
        want = maximal(scores)
        assert [s for *_, s in found] == pytest.approx([s for *_, s in want])
        for begin, end, total in found:
            assert total == pytest.approx(sum(scores[begin:end]))
            sums = np.cumsum(scores[begin:end])
            assert sums.min() > 0 and sums.max() == pytest.approx(total)


def test_segments_take_linear_time():
    import time

    draw = np.random.default_rng(1)

    def seconds(n):
        scores = draw.normal(-0.05, 1, n)
        begin = time.perf_counter()
        toxicity.segments(scores)
        return time.perf_counter() - begin

    seconds(50_000)
    assert seconds(400_000) < 30 * max(seconds(50_000), 1e-3)


def test_law_of_chance():
    values, counts = np.array([-1.0, 1.0]), np.array([3.0, 1.0])
    assert toxicity.root(values, counts) == pytest.approx(np.log(3), abs=1e-9)
    slope, offset = toxicity.curve(np.array([0.0, 1.0]), np.array([10.0, 90.0]), np.array([90.0, 10.0]))
    assert offset == pytest.approx(np.log(1 / 9), abs=0.02) and slope == pytest.approx(2 * np.log(9), abs=0.05)
    assert toxicity.curve(np.array([0.0, 1.0]), np.array([9.0, 1.0]), np.array([1.0, 9.0]))[0] == 0


def planted(n):
    draw = random.Random(8)
    words = ["ba", "do", "ka", "lumo", "tari", "sen", "vok", "mire", "polda", "hunet"]
    rows, marks = [], []
    for i in range(n):
        text = draw.choices(words, k=draw.randrange(20, 120))
        bad = draw.random() < 0.25
        if bad:
            at = draw.randrange(len(text))
            text[at:at] = draw.choices(["grobian", "wicht", "schuft"], k=3)
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    return rows, marks


def test_held_out_accuracy_and_passages(spark):
    rows, marks = planted(600)
    df = docs(spark, rows)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    found = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(df, model).collect()}
    held = [(i, bad) for i, bad in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80
    right = sum((found[i]["score"] >= 0.5) == bool(bad) for i, bad in held)
    assert right >= 0.98 * len(held)
    for i, bad in marks:
        words = toxicity.words_of(rows[i][1])
        passages = [words[p["begin"] : p["end"]] for p in found[i]["passages"]]
        assert bool(passages) == bool(bad)
        assert all(set(p) & {"grobian", "wicht", "schuft"} for p in passages)


def test_held_out_labels_and_other_columns_are_never_read(spark):
    rows, marks = planted(300)
    df = docs(spark, rows)
    turned = [(i, 1 - bad if zlib.crc32(str(i).encode()) % 5 == 0 else bad) for i, bad in marks]
    one, two = (
        toxicity.fit(df, spark.createDataFrame(m, "doc_id long, toxic int")) for m in (marks, turned)
    )
    assert one.names == two.names and (one.scores == two.scores).all() and one.offset == two.offset


def test_special_rows(spark):
    labels = spark.createDataFrame(
        [(1, 0, 1), (1, 1, 1), (2, 1, 0), (3, 0, 0), (4, 0, 1), (9, 1, None), (None, 1, 1), (777, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    for df in (docs(spark), clashing(spark)):
        found = toxicity.scored(df, toxicity.fit(df, labels)).collect()
        assert len(found) == len(ROWS)
        assert all(0 <= r["toxicity"]["score"] <= 1 for r in found)
        empty = {r["toxicity"]["score"] for r in found if not toxicity.words_of(r["text"] or "")}
        assert len(empty) == 1
    assert CLASHING.split(",")[0].split()[0] in toxicity.scored(clashing(spark), toxicity.fit(docs(spark), labels)).columns
    nothing = docs(spark, [])
    assert toxicity.scored(nothing, toxicity.fit(nothing, labels)).count() == 0
    without = toxicity.fit(docs(spark), labels.where("false"))
    assert {r["toxicity"]["score"] for r in toxicity.scored(docs(spark), without).collect()} == {0.5}


def test_query(spark, sf_dir):
    found = {r["doc_id"]: r for r in queries.op13_toxic_segments(spark, sf_dir).collect()}
    assert len(found) == 200
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["predicted"] == (r["score"] >= 0.5)
