"""De-duplication, near copies, shards, quality rules against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.data import BASE, ROWS, clashing, docs, prose, text_of
from veilframe.llm import exact_dedup, ngram_join, quality_lists, sharding, shingles
from veilframe.llm.components import components
from veilframe.llm.membership import may_be_among


# --- exact copies -----------------------------------------------------------------------


def test_flagged(spark):
    groups = defaultdict(list)
    for key, text in ROWS:
        groups[text or ""].append(key)
    found = exact_dedup.flagged(clashing(spark)).collect()
    assert len(found) == len(ROWS)
    kept = Counter()
    shas = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in found:
        keys = groups[shas[r["text_sha256"]]]
        assert r["group_size"] == len(keys)
        assert r["keep_id"] == max((k for k in keys if k is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert exact_dedup.flagged(docs(spark, [])).count() == 0


def test_deduplicated_keeps_whole_rows(spark):
    found = exact_dedup.deduplicated(clashing(spark))
    assert found.columns == clashing(spark).columns
    rows = found.collect()
    assert len(rows) == len({r[1] or "" for r in ROWS})
    assert {r["doc_id"] for r in rows if r["text"] == BASE} == {2}
    assert exact_dedup.deduplicated(docs(spark, [])).count() == 0


def test_dedup_has_no_python(spark):
    plan = exact_dedup.flagged(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_full_filter_gives_the_same(spark, monkeypatch):
    want = sorted(map(str, exact_dedup.flagged(docs(spark)).collect()))
    monkeypatch.setattr(exact_dedup, "MIN_BITS", 1 << 15)
    kept = sorted(map(str, exact_dedup.deduplicated(clashing(spark)).collect()))
    for size in ((2, 1), (1 << 15, 4), (2, 2)):
        monkeypatch.setattr(exact_dedup, "filter_size", lambda rows, size=size: size)
        assert sorted(map(str, exact_dedup.flagged(docs(spark)).collect())) == want
        assert sorted(map(str, exact_dedup.deduplicated(clashing(spark)).collect())) == kept


def test_filters_grow_with_the_rows():
    for rows in (0, 1, 10**6, 10**8, 10**11):
        bits, ranges = exact_dedup.filter_size(rows)
        assert exact_dedup.MIN_BITS <= bits <= exact_dedup.MAX_BITS
        assert rows * exact_dedup.BITS_PER_ROW <= bits * ranges < max(4 * rows * exact_dedup.BITS_PER_ROW, 1 << 16)


# --- near copies ------------------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_classes(texts):
    sets = [shingle_set(t) for t in texts]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and n and 5 * n >= 4 * len(a | sets[j]):
                links[i].add(j)
                links[j].add(i)
    label = list(range(len(sets)))
    for i in range(len(sets)):
        stack = [i] if label[i] == i else []
        while stack:
            at = stack.pop()
            for j in links[at]:
                if label[j] != label[i]:
                    label[j] = label[i]
                    stack.append(j)
    return label, [len(links[i]) for i in range(len(sets))]


def family(seed, size, words=150, edits=3):
    draw = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for i in range(size):
        copy = list(base)
        for _ in range(draw.randrange(edits + 1)):
            copy[draw.randrange(words)] = f"edit{draw.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("options", [{}, {"split_above": 4, "sketch_block": 3, "text_block": 3}])
def test_similar_equals_brute_force(spark, options):
    texts = family(11, 30) + family(12, 12, words=12, edits=1) + family(13, 8, words=4)
    # a passage that unlike texts share
    passage = prose(14, 20)
    texts += [f"{passage} {prose(100 + i, 100)}" for i in range(40)]
    texts += [prose(300 + i, 30) for i in range(30)] + ["", " \n", "x"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in ngram_join.similar(docs(spark, rows), **options).collect()}
    label, links = brute_classes(texts)
    assert {k: (r["class_id"], r["n_links"]) for k, r in got.items()} == {
        i: (label[i], links[i]) for i in range(len(texts))
    }


def test_similar_takes_all_rows(spark):
    found = ngram_join.similar(clashing(spark)).collect()
    assert len(found) == len(ROWS)
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert by[1][0]["class_id"] == by[2][0]["class_id"] == by[3][0]["class_id"] == 1
    assert by[1][0]["n_links"] == 3 and by[1][0]["n_partners"] == 1  # 2, 3 and a null key
    assert by[4][0]["n_links"] == by[5][0]["n_links"] == by[6][0]["n_links"] == 0
    assert [r["n_links"] for r in by[9]] == [1, 1]
    kept = ngram_join.representatives(clashing(spark))
    assert kept.columns == clashing(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(9) == 1
    assert ids.count(None) == 1 and {4, 5, 6} <= set(ids)
    assert ngram_join.similar(docs(spark, [])).count() == 0
    assert ngram_join.representatives(docs(spark, [])).count() == 0


def test_recall_bound():
    q = 1.0
    for _ in range(200):
        q = 1 - (1 - 0.8 * q) ** ngram_join.BRANCHES
    assert 1 - (1 - q) ** ngram_join.runs_for(0.8, 0.9995) >= 0.9995


def test_shingles_and_counts():
    texts = [text_of(r) for r in ROWS]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    got = ngram_join.common_counts(sets)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert got[i, j] == len(shingle_set(a) & shingle_set(b))
    mins = shingles.minimum_hashes(shingles.shingle_sets([BASE, BASE, ""]))
    assert (mins[0] == mins[1]).all() and (mins[2] == 0xFFFFFFFF).all()


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)]
    edges += [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 790)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- shards -----------------------------------------------------------------------------


def test_difference_is_a_partition():
    draw = random.Random(9)
    for width in (2, 3, 16):
        sizes = [draw.randint(1, 1000) for _ in range(200)]
        places, total = sharding.difference([[s] + [0] * (width - 1) for s in sizes])
        sums = [0] * width
        for size, place in zip(sizes, places, strict=True):
            assert sorted(place) == list(range(width))
            sums[place[0]] += size
        assert sums == total and max(sums) - min(sums) <= 16


@pytest.mark.parametrize("task_items,driver_items", [(1000, 4000), (4, 2)])
def test_shards(spark, monkeypatch, task_items, driver_items):
    monkeypatch.setattr(sharding, "TASK_ITEMS", task_items)
    monkeypatch.setattr(sharding, "DRIVER_ITEMS", driver_items)
    rows = ROWS + [(100 + i, prose(i, 20 + i)) for i in range(60)]
    found = sharding.shard(docs(spark, rows), shards=4).collect()
    assert len(found) == len(rows)
    slots, total = defaultdict(list), Counter()
    sizes = Counter(len((t or "").encode()) + 1 for _, t in rows)
    assert Counter(r["size"] for r in found) == sizes
    for r in found:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    base = {r["shard"] for r in found if r["size"] == len(BASE) + 1 and r["doc_id"] in (1, 2, None)}
    assert len(base) == 1
    assert sharding.shard(docs(spark, [])).count() == 0


def test_shards_are_even(spark):
    rows = [(i, prose(i, 5 + i % 90)) for i in range(500)]
    total = Counter()
    for r in sharding.shard(docs(spark, rows)).collect():
        total[r["shard"]] += r["size"]
    assert len(total) == 16 and max(total.values()) - min(total.values()) <= 2


@pytest.mark.parametrize("part", [0.05, 1 / 3])
def test_a_large_group_is_leveled(spark, part):
    draw = random.Random(5)
    sizes = [draw.randint(50, 20_000) for _ in range(sharding.DRIVER_ITEMS + 4_000)]
    sizes.append(int(sum(sizes) * part / (1 - part)))
    groups = spark.createDataFrame([(f"g{i}", s) for i, s in enumerate(sizes)], "item string, size long")
    totals = []
    for tasks in (1, 7):
        total = Counter()
        for r in sharding.balanced(groups.repartition(tasks), "item", "size").collect():
            total[r["shard"]] += sizes[int(r["item"][1:])]
        totals.append(sorted(total.values()))
    assert totals[0] == totals[1] and sum(totals[0]) == sum(sizes) and len(totals[0]) == 16
    if part > 1 / 16:
        assert totals[0].pop() == sizes[-1]
    assert totals[0][-1] - totals[0][0] <= 0.001 * sum(totals[0]) / len(totals[0])


# --- quality rules ----------------------------------------------------------------------


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        again,
        len(covered),
    )


def test_counts_equal_brute_force():
    draw = random.Random(8)
    texts = [text_of(r) for r in ROWS]
    texts += ["".join(draw.choices(["a", "b ", " ", "\n", "c\n", "#", "é", "\x1c", "\xa0", "\t"], k=60)) for _ in range(500)]
    for text in texts:
        assert quality_lists.features_of(text)[:5] == counts_by_hand(text), text[:80]


def labelled(spark, n=400):
    draw = random.Random(10)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, draw.randint(60, 200))
        if bad:
            text = " ".join(w + draw.choice(["###", "***", "$$$"]) for w in text.split())
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_on_held_out_rows(spark):
    df, labels = labelled(spark)
    rules = quality_lists.fit(df, labels.where("doc_id < 250"))
    assert rules and all(len(r) <= quality_lists.MAX_TERMS for r in rules)
    held = quality_lists.judged(df.where("doc_id >= 250"), rules).join(labels, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in held]) >= 0.98


def test_judged_takes_all_rows(spark):
    found = quality_lists.judged(clashing(spark), [])
    rows = found.collect()
    assert len(rows) == len(ROWS) and found.columns.count("kept") == 1
    for r in rows:
        counts = counts_by_hand(r["text"] or "")
        assert tuple(r[c] for c in quality_lists.COUNTS) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_lists.fit(docs(spark), none) == []
    odd = spark.createDataFrame([(1, None, None), (None, 0, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_lists.fit(docs(spark), odd) == []
    assert quality_lists.judged(docs(spark, []), []).count() == 0


# --- membership -------------------------------------------------------------------------


def test_members_are_never_missed(spark):
    rows = spark.range(3000).selectExpr("xxhash64(id) AS h", "id AS _part")
    members = spark.range(0, 3000, 30).selectExpr("xxhash64(id) AS m")
    found = may_be_among(rows, "h", members, "m", "near").collect()
    assert len(found) == 3000
    assert all(r["near"] for r in found if r["_part"] % 30 == 0)
    assert sum(r["near"] for r in found) < 400
    none = may_be_among(rows, "h", members.limit(0), "m", "near")
    assert none.where("near").count() == 0 and none.columns == ["h", "_part", "near"]
