"""Every registered query runs and, where it has one, equals its oracle."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    if name in entry.oracle_sql():
        ok, note = compare(spark, con, name, sf_dir)
        assert ok, note
    else:
        assert df.count() > 0


def test_supplied_spans_lie_all_over_the_texts(spark, sf_dir):
    queries = entry.queries()
    spans = queries["D9_known_entities_whole"](spark, sf_dir).collect()
    assert max(s["start"] for s in spans) > 1_000 and len({s["label"] for s in spans}) > 3
    assert all(len(s["text"]) == s["end"] - s["start"] for s in spans)
    known = queries["D9_redact_known_whole"](spark, sf_dir).collect()
    assert sum(r["n_spans"] for r in known) == len(spans)
    files = queries["S13_file_redaction_whole"](spark, sf_dir).collect()
    assert sum(r["n_spans"] for r in files) > 0
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z0-9]", r["redacted_text"]) for r in files)
