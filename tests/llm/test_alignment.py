"""Token alignment against a version that walks the bytes of one text at a time."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.data import ROWS, clashing, docs
from tests.llm.test_tokens import strange_texts
from veilframe.llm import queries, token_alignment

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


ALPHABET = token_alignment.byte_alphabet()


@cache
def spelled_a(a, i):
    return bytes(ALPHABET[c] for c in a.id_to_token(i))


@cache
def spelled_b(b, i):
    piece = b.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()


def groups_of(text, a, b):
    if not text:
        return []
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    raw = [[spelled_a(a, i) for i in ids[0]], [spelled_b(b, i) for i in ids[1]]]
    if any(b"".join(x) != (" " + text).encode() for x in raw):
        return []
    found, group, ends = [], ([], []), [0, 0]
    at = [0, 0]
    while at[0] < len(ids[0]) or at[1] < len(ids[1]):
        side = 0 if ends[0] <= ends[1] and at[0] < len(ids[0]) else 1
        group[side].append(ids[side][at[side]])
        ends[side] += len(raw[side][at[side]])
        at[side] += 1
        if ends[0] == ends[1]:
            found.append(group)
            group = ([], [])
    return found


def brute(rows, sides):
    texts = [groups_of(text, *sides) for _, text in rows]
    counts = Counter(
        p for groups in texts for p in {(x, y) for ga, gb in groups for x in ga for y in gb}
    )
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (key, _), groups in zip(rows, texts, strict=True):
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        spelled = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append(
            (
                key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups),
                len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
            )
        )
    return Counter(out)


def results(df):
    return Counter(tuple(r[f] for f in FIELDS) for r in df.collect())


def test_special_and_strange_texts(spark, sides):
    draw = random.Random(4)
    rows = ROWS + [(100 + i, t) for i, t in enumerate(strange_texts(300))]
    rows += [(900 + i, "".join(draw.choices("漢字仮名éü🙏🏼ÀА𝒳 ", k=60))) for i in range(40)]
    rows += [(990, "a▁b"), (991, "<s> </s> <unk> <0x41>"), (992, "<|endoftext|>")]
    df = docs(spark, rows).repartition(3)
    found = results(token_alignment.align(df, JSON, MODEL))
    assert found == brute(rows, sides)
    special = {r[0]: r for r in found}
    assert special[990][1:] == (0, 0, 0, 0, 0, 0, "")
    assert special[991][1] > 0 and special[992][1] > 1


def test_overlaps_are_all_pairs_that_share_a_byte():
    side_a = token_alignment._side(token_alignment.ByteTokens, JSON)
    side_b = token_alignment._side(token_alignment.PieceTokens, MODEL)
    a, b = token_alignment.encoded(["an overlapping sentence, überall", "", "漢字 x"], side_a, side_b)
    left, right = token_alignment.overlaps(a, b)
    want = {
        (i, j)
        for i in range(len(a.ids))
        for j in range(len(b.ids))
        if a.start[i] < b.end[j] and b.start[j] < a.end[i]
    }
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == want
    assert len(left) == len(want)


def test_segments_are_encoded_as_in_the_text(sides):
    side_a = token_alignment._side(token_alignment.ByteTokens, JSON)
    side_b = token_alignment._side(token_alignment.PieceTokens, MODEL)
    texts = [t for t in strange_texts(1500) if t and "▁" not in t] + [" ", "   ", "a ", " a", "\n a", "a\n  b ", "a  b"]
    a, b = token_alignment.encoded(texts, side_a, side_b)
    for i, text in enumerate(texts):
        assert a.ids[a.doc == i].tolist() == sides[0].encode(" " + text, add_special_tokens=False).ids
        assert b.ids[b.doc == i].tolist() == sides[1].encode(text)


def test_byte_tokens_of_all_characters(sides):
    side = token_alignment._side(token_alignment.ByteTokens, JSON)
    places = [c for c in range(1, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}" for c in places]
    found = sides[0].encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert all(side.encode_all(t) == f.ids for t, f in zip(texts, found, strict=True))


def test_cells_do_not_grow_with_the_block(spark, sf_dir):
    df = queries.table(spark, sf_dir, "documents").coalesce(1)
    rows = token_alignment.blocks(df, JSON, MODEL).collect()
    longest = max(len(r["text"] or "") for r in df.collect())
    assert max(len(cell) for r in rows for cell in r if hasattr(cell, "__len__")) <= longest
    lists = sorted((r for r in rows if r["pairs"] is not None), key=lambda r: (r["block"], r["first"]))
    assert len(lists) > 1 and len(rows) - len(lists) == df.count()
    for r, after in zip(lists, lists[1:]):
        if r["block"] == after["block"]:
            assert r["first"] + len(r["pairs"]) == after["first"] and r["pairs"][-1] < after["pairs"][0]


def test_blocks_of_any_part_are_equal():
    side_a = token_alignment._side(token_alignment.ByteTokens, JSON)
    side_b = token_alignment._side(token_alignment.PieceTokens, MODEL)
    texts = ["", "a▁b", "one two  three", "", "überall 漢字 " * 40, *strange_texts(300), "x" * 3000, " "]
    whole = token_alignment.block_of(texts, side_a, side_b, 10**9)
    assert sum(map(bool, whole.shas)) > 40
    for most in (1, 7, 100, 5000):
        found = token_alignment.block_of(texts, side_a, side_b, most)
        for name, want in vars(whole).items():
            assert np.array_equal(getattr(found, name), want), (most, name)


def test_memory_of_a_part_is_bounded():
    side_a = token_alignment._side(token_alignment.ByteTokens, JSON)
    side_b = token_alignment._side(token_alignment.PieceTokens, MODEL)
    text = " ".join(random.Random(5).choices(["one", "überall", "1234", "alignment", "x-y"], k=150_000))

    def peak(most):
        tracemalloc.start()
        token_alignment.block_of([text], side_a, side_b, most)
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    assert peak(token_alignment.PART_TOKENS) < 0.6 * peak(10**9)


def test_packed_numbers():
    for most in (0, 1, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**62):
        values = np.array([0, most, most // 2], np.int64)
        assert token_alignment.unpacked(token_alignment.packed(values, most)).tolist() == values.tolist()
    assert token_alignment.unpacked(token_alignment.packed(np.zeros(0, np.int64), 0)).tolist() == []


def test_clashing_columns_and_empty_table(spark, sides):
    assert results(token_alignment.align(clashing(spark), JSON, MODEL)) == brute(ROWS, sides)
    assert token_alignment.align(docs(spark, []), JSON, MODEL).columns == FIELDS
    assert token_alignment.align(docs(spark, []), JSON, MODEL).count() == 0


def test_query(spark, sf_dir, sides):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert results(queries.op11_token_alignment(spark, sf_dir)) == brute(rows, sides)
