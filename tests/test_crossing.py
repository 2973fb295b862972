"""Entities across rows: cuts, units, and the whole-group result."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import reach
from veilframe.operators import conversation
from veilframe.policy import Policy

PATTERNS = [
    r"[a-b]+\n[a-c]+", r"a\nb", r"(?:a|bc)*\nd?", r"a{2,3}\s{1,2}b", r"(?i)A\n?b+c", r"[^a]b\n",
    r"a.c\na", r"(?>a+)b?\nc", r"\p{Lu}?a\nb", r"(?:b?\n){2}c", r"[^\n]*\n[^\n]*",
]


def test_no_match_lies_across_a_cut():
    draw = random.Random(1)
    for _ in range(1500):
        pattern = draw.choice(PATTERNS)
        machine = reach.automaton((pattern,), "\n")
        python = re.compile(pattern.replace(r"\p{Lu}", "[A-Z]"))
        text = "".join(draw.choices("abcdA\n", k=draw.randrange(14)))
        spans = [
            (i, j) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if python.fullmatch(text, i, j)
        ]
        going = 0
        for at in range(len(text) + 1):
            assert going or not any(i < at < j for i, j in spans)
            if at < len(text):
                going = machine.step(going | machine.start, text[at])


@pytest.mark.parametrize("regex", [r"\bfoo\n", r"^a\n", r"a(?=\n)b", r"(a)\n\1", r"\p{IsGreek}\n", "a{3000}\n"])
def test_patterns_whose_reach_is_unknown(regex):
    assert not reach.supported([regex], "\n")


def rows(seed, n, groups, alphabet):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(draw.choices(alphabet, k=draw.randrange(9)))
        out.append((draw.randrange(groups), i * 3 - 40, draw.choice([text, text, text, None]) if i % 9 == 0 else text))
    return out


def both(spark, monkeypatch, data, policy):
    df = spark.createDataFrame(data, "g long, n long, text string").repartition(5)
    results = []
    for known in (True, False):
        if not known:
            monkeypatch.setattr(conversation, "crossing", lambda *_: None)
        found = conversation.redact_rows(df, policy, ["g"], "n").orderBy("g", "n").collect()
        results.append([r.asDict(True) for r in found])
    return results


@pytest.mark.parametrize("pattern", PATTERNS)
def test_equal_to_whole_groups(spark, monkeypatch, pattern):
    policy = Policy(
        default="Off",
        config={"LAW": "Redaction", "EVENT": "Redaction"},
        allow={"LAW": [pattern], "EVENT": [r"[bc]{2}", "a"]},
        claim_off=False,
        seed=3,
    )
    pieces, whole = both(spark, monkeypatch, rows(5, 160, 3, "aabbccdA  "), policy)
    assert pieces == whole
    assert any(r["spans"] for r in pieces)


def test_builtin_labels_beside_a_crossing_pattern(spark, monkeypatch):
    data = [
        (1, 0, "Call 555-123-4567 or write to ann"), (1, 1, "Lee at a.b@example.com"), (1, 2, None),
        (1, 3, "see"), (1, 4, "Ann"), (1, 5, "Lee"), (2, 0, "Ann"), (2, 7, "Lee 10.0.0.1"), (2, 9, ""),
        (3, -5, "ann lee"),
    ]
    policy = Policy(default="Redaction", allow={"NRP": [r"(?i)ann\s+lee"]}, seed=1)
    pieces, whole = both(spark, monkeypatch, data, policy)
    assert pieces == whole
    assert [r["redacted_text"] for r in pieces if r["g"] == 1][0].startswith("Call [PHONE_NUMBER_")
    assert sum(s["label"] == "NRP" for r in pieces for s in r["spans"]) == 7


def test_units_are_as_long_as_matches_reach(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.lit(1).alias("g"), (F.col("conv_id") * 64 + F.col("turn")).alias("n"), "text"
    )
    across = conversation.detection.rules({"LAW": [r"[A-Za-zÀ-ÿ]+[.]\n[A-ZÀ-Þ][a-zà-ÿ]+"]})
    pieces = conversation.row_pieces(df, ["g"], "n", "text", [], across).collect()
    assert len(pieces) == df.count()
    for r in pieces:
        assert r["_middle"] is not None
        assert len(r["_head"]["text"]) + len((r["_tail"] or {"text": ""})["text"]) < 60
        parts = [r["_head"], r["_middle"], r["_tail"]]
        assert "".join(p["text"] for p in parts if p) == r["_text"]


def test_plan_holds_no_whole_group(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    policy = Policy(default="Off", config={"LAW": "Redaction"}, allow={"LAW": [r"a\nb"]}, claim_off=False)
    done = conversation.redact_rows(df, policy, ["conv_id"], "turn")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    collected = [line for line in plan.splitlines() if "collect_list" in line]
    assert collected and all("," in re.search(r"Aggregate \[([^\]]*)\]", line)[1] for line in collected)
