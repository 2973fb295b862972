"""Operators whose work must follow the rows: results against brute force, time against
twice the input, plans without texts in exchanges."""

from __future__ import annotations

import os
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from registry import QUERIES
from veilframe.functions.sql import col
from veilframe.operators import chunking, json_text, markup, ordered, quality, reports, vault
from veilframe.operators.gazetteer import gazetteer_hits, with_gazetteer
from veilframe.operators.redact import redact_frame
from veilframe.plans import jobs
from veilframe.policy import Policy
from veilframe.session import settle
from veilframe.sources import files, texts

MAIL = Policy(default="Off", config={"EMAIL_ADDRESS": "Redaction"}, claim_off=False, seed=3)


def seconds(action):
    begin = time.perf_counter()
    action()
    return time.perf_counter() - begin


# --- unredaction ------------------------------------------------------------------------


def redacted(spark, n=200):
    rows = [(i, f"write to a{i % 7}@x.org or b{i}@y.org " + "pad " * 50) for i in range(n)]
    return settle(redact_frame(spark.createDataFrame(rows, "id long, text string"), MAIL, "text", "id"))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bExchange\b", line)], plan


def test_unredaction_moves_no_text(spark):
    done = redacted(spark)
    store = settle(vault.vault_of(done))
    small = vault.unredact(done.select("id", "redacted_text"), store, "id")
    assert not exchanges(small)[0]
    assert [r.unredacted_text for r in small.orderBy("id").collect()] == [r.text for r in done.orderBy("id").collect()]


def test_unredaction_of_a_bucketed_table_moves_tokens_only(spark):
    done = vault.store_bucketed(redacted(spark), "id")
    store = settle(vault.vault_of(done))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = vault.unredact(done.select("id", "redacted_text"), store, "id", broadcast=False)
        found, plan = exchanges(back)
        scan = [line for line in plan.splitlines() if "Bucketed: true" in line and "redacted_text" in line]
        assert found and scan
        above = plan.splitlines()
        # the branch of the texts goes from the bucketed scan to the join without an exchange
        join = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
        left = above[join + 1 : next(i for i, line in enumerate(above) if i > join and "Bucketed: true" in line) + 1]
        assert not any("Exchange" in line for line in left)
        assert [r.unredacted_text for r in back.orderBy("id").collect()] == [r.text for r in done.orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- gazetteer --------------------------------------------------------------------------

TERMS = [("LAW", "new york"), ("LAW", "New York City"), ("EVENT", "york"), ("EVENT", "a b a"), ("EVENT", "a b"), ("NRP", "New York")]


def test_trie_in_place_and_by_joins(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices(["New", "york,", "City", "a", "b", "x-y"], k=draw.randrange(30)))) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, None), (98, "")], "doc_id long, text string").repartition(3)
    gaz = spark.createDataFrame([*TERMS, ("X", None), (None, "a")], "label string, term string")
    want = set()
    for doc, text in rows:
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[a-zA-Z]+(?:-[a-zA-Z]+)*", text)]
        for label, term in TERMS:
            term = term.lower().split(" ")
            for i in range(len(words) - len(term) + 1):
                if [w[2] for w in words[i : i + len(term)]] == term:
                    want.add((doc, label, words[i][0], words[i + len(term) - 1][1]))
    for inline in (True, False):
        found = gazetteer_hits(df, gaz, inline=inline).collect()
        assert {(r.doc_id, r.label, r.start, r.end) for r in found} == want and len(found) == len(want)
        spans = with_gazetteer(df, gaz, inline=inline).collect()
        assert sum(len(r.extra or []) for r in spans) == len(want)
        assert all(r.text[s.start : s.end] == s.text for r in spans for s in r.extra or [])


def test_a_long_term_costs_nothing(spark):
    draw = random.Random(1)
    df = settle(spark.createDataFrame(
        [(i, " ".join(str(draw.randrange(500)) for _ in range(800))) for i in range(400)], "doc_id long, text string"
    ))
    short = [("LAW", f"{i} {i + 1}") for i in range(300)]
    long = [*short, ("LAW", " ".join(str(i) for i in range(500)))]
    times = []
    for terms in (short, long, short, long):
        gaz = spark.createDataFrame(terms, "label string, term string")
        times.append(seconds(lambda gaz=gaz: gazetteer_hits(df, gaz).count()))
    assert times[3] < 1.2 * times[2] + 0.5


# --- files and numbers ------------------------------------------------------------------


def test_named_files(spark, tmp_path):
    rows = [(f"{i % 3}/same{i // 3}.txt", f"mail m{i}@x.org ü") for i in range(30)]
    rows += [("top +%20 name.txt", ""), ("deep/er/x.txt", None)]
    df = spark.createDataFrame(rows, "file_name string, text string").repartition(4)
    folder = str(tmp_path / "in")
    texts.write_files(df, folder)
    kept = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)
    assert kept == sorted([r[0] for r in rows] + ["_SUCCESS"])
    want = {r[0]: r[1] or "" for r in rows}
    assert {r.file_name: r.text for r in files.read(spark, folder).collect()} == want
    found = texts.read_texts(spark, folder, below=True).collect()
    filled = {name: text for name, text in want.items() if text}
    assert {r.file_name: r.text for r in found} == filled
    with pytest.raises(Exception, match="finished job"):
        texts.write_files(df, folder)
    jobs.redact_files(spark, folder, str(tmp_path / "out"), MAIL)
    direct = redact_frame(df.where("text <> ''"), MAIL, "text", "file_name").collect()
    done = {r.file_name: r.text for r in files.read(spark, str(tmp_path / "out")).collect()}
    assert all(done[r.file_name] == r.redacted_text for r in direct)
    assert done.keys() == filled.keys()


@pytest.mark.parametrize("name", ["../x", "/x", "a//b", "", "a/../../b", "._x", "_SUCCESS"])
def test_names_stay_below_their_folder(spark, tmp_path, name):
    df = spark.createDataFrame([(name, "x")], "file_name string, text string")
    with pytest.raises(Exception):
        texts.write_files(df, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out" / "_SUCCESS") and not os.path.exists(tmp_path / "x")


def test_failed_job_leaves_no_mark_and_no_part(spark, tmp_path):
    df = spark.range(40).select(
        F.concat(F.lit("f"), "id").alias("file_name"),
        F.when(F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("text"),
    )
    with pytest.raises(Exception, match="stop"):
        texts.write_files(df, str(tmp_path / "out"))
    left = os.listdir(tmp_path / "out") if os.path.exists(tmp_path / "out") else []
    assert "_SUCCESS" not in left and not any(x.startswith("._") for x in left)


def test_consecutive_numbers(spark):
    df = spark.range(1000).repartition(7).where("id % 3 > 0")
    found = ordered.numbered(df, "n").collect()
    assert sorted(r.n for r in found) == list(range(len(found)))
    by = ordered.numbered(df, "n", ["id"], start=5).orderBy("id").collect()
    assert [r.n for r in by] == list(range(5, 5 + len(by)))


def test_default_names_over_files_and_splits(spark, tmp_path):
    for part, n in ((0, 40), (1, 900), (2, 3)):
        lines = "".join('{"text": "t%d", "fileName": %s}\n' % (i, f'"own{i}"' if i == 2 else "null") for i in range(n))
        (tmp_path / f"part{part}.json").write_text(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        gold = texts.read_training_rows(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    names = {(r.fileName, r.text) for r in gold}
    want, at = set(), 0
    for n in (40, 900, 3):
        for i in range(n):
            want.add((f"own{i}.txt" if i == 2 else f"training_file_{at}.txt", f"t{i}"))
            at += 1
    assert names == want


# --- linear row work --------------------------------------------------------------------


def test_overlap_recall_by_sweep(spark):
    draw = random.Random(3)

    def spans(n, docs):
        return [(draw.randrange(docs), s := draw.randrange(300), s + draw.randrange(1, 9)) for _ in range(n)]

    ours, theirs = spans(400, 3), spans(300, 4)
    schema = "d int, start int, end int"
    found = quality.overlap_recall(spark.createDataFrame(ours, schema), spark.createDataFrame(theirs, schema), "d")
    want = defaultdict(lambda: [0, 0])
    for d, s, e in set(theirs):
        want[d][0] += 1
        want[d][1] += any(x == d and a < e and b > s for x, a, b in ours)
    assert {r.d: [r.n_gold, r.n_hit] for r in found.collect()} == dict(want)


def test_first_seen_texts(spark):
    draw = random.Random(5)
    rows = [(draw.choice("gh"), draw.choice("LM"), str(draw.randrange(40)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, label string, text string, at long").repartition(5)
    found = reports.first_seen(df, ["g"], "at").collect()
    want = defaultdict(list)
    for g, label, text, _ in rows:
        if text not in want[g, label]:
            want[g, label].append(text)
    got = defaultdict(dict)
    for r in found:
        got[r.g, r.label][r.position] = r.text
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == dict(want)


def test_paths_of_many_siblings_are_linear(spark):
    def page(n):
        body = "".join(f"<p>{i}</p><i/>" if i % 2 else f"<b>{i}</b>" for i in range(n))
        return spark.createDataFrame([(f"<r>{body}</r>",)], "x string").withColumn(
            "_parts", markup.segments(col("x"), False).column()
        ).select(markup.paths(col("_parts"), False).column().alias("p"))

    (row,) = page(100).collect()
    assert "/r[1]/p[50]" in row.p and "/r[1]/b[50]" in row.p and "/r[1]/b[51]" not in row.p
    seconds(lambda: page(2000).collect())
    one, two = (min(seconds(lambda n=n: page(n).collect()) for _ in range(2)) for n in (20_000, 40_000))
    assert two < 2.8 * one + 0.3


def test_moved_borders(spark):
    spans = [(2, 5, 2, 9), (5, 6, 9, 10), (8, 12, 12, 13)]
    df = spark.createDataFrame([([0, 3, 3, 8, 8, 14], spans), ([0, 4], None)], "b array<int>, s array<struct<start:int,end:int,new_start:int,new_end:int>>")
    rows = df.select(chunking.moved_borders(col("b"), col("s")).column().alias("m")).collect()
    assert sorted(r.m for r in rows) == [[0, 4], [0, 9, 9, 12, 12, 15]]


# --- small documents made of table rows ---------------------------------------------------


@pytest.mark.parametrize("name", ["T5_xml_paths", "T5_redact_xml", "T6_straddling_and_attributes"])
def test_markup_of_a_table_in_one_split_uses_all_cores(spark, sf_dir, name):
    done = QUERIES[name](spark, sf_dir)
    assert done.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(
    "name", ["T1_json_leaves", "T1_redact_json", "T2_json_path_allow", "T3_json_ignore_paths", "T4_json_span_paths"]
)
def test_rows_of_a_json_task_are_bounded(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr("registry.texts._TASK_ROWS", 40, raising=False)
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 25


def in_lambdas(df, name):
    """Expressions of the class ``name`` inside lambdas of the optimized plan."""
    found, plans = [], [df._jdf.queryExecution().optimizedPlan()]

    def walk(e, inside):
        kind = e.getClass().getSimpleName()
        if inside and kind == name:
            found.append(e.toString()[:200])
        for i in range(e.children().size()):
            walk(e.children().apply(i), inside or kind == "LambdaFunction")

    while plans:
        plan = plans.pop()
        for i in range(plan.expressions().size()):
            walk(plan.expressions().apply(i), False)
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_lambdas_hold_no_detection(spark):
    """The optimizer may put an expression in place of its column, in a lambda once an element."""
    policy = Policy(default="Off", config={"LAW": "Redaction"}, allow={"LAW": ["[0-9]+"]}, claim_off=False)
    df = spark.createDataFrame([(1, '{"a": [1, "2 x", {"b": "3"}]}')], "id int, json string")
    assert not in_lambdas(json_text.redact_json(df, policy, "json", "id").select("redacted_text"), "RegExpReplace")


def test_sentences_are_searched_once(spark, sf_dir):
    plan = QUERIES["D1_sentences"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_replace" in line]
