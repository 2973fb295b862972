"""Encoders, counts, packing and token files against the libraries."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.data import ROWS, clashing, docs, text_of
from veilframe.llm import packing, piece_bpe, token_counts, token_files
from veilframe.llm.common import shared_path
from veilframe.llm.word_encoder import WordEncoder

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = (
    ["a", "B1", " ", ".", "b,", " c!", "\n", "\t", "\0", "\x85", "\xa0", "'s", "!", "é", " ", "\x1c"]
    + ["<|endoftext|>", "漢", " the", "▁", "▁▁", "  ", "\n ", " \n", "<s>", "<0x41>", "🙏", "ing", "er"]
)


def strange_texts(n):
    draw = random.Random(7)
    return ["".join(draw.choices(PARTS, k=draw.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_word_encoder_equals_library(library):
    texts = strange_texts(3000) + [text_of(r) for r in ROWS]
    encoder = WordEncoder(JSON)
    for _ in range(2):  # new words, then known ones
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.counts(texts) == [len(x) for x in got]


def test_word_encoder_for_files_that_cannot_be_cut():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = WordEncoder(path), Tokenizer.from_file(path)
    assert not encoder.by_word
    texts = strange_texts(200)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_equal_library(pieces):
    model = piece_bpe.PieceModel(MODEL)
    draw = random.Random(3)
    texts = strange_texts(3000) + [text_of(r) for r in ROWS]
    texts += [" " * n for n in range(40)] + ["a" * n for n in range(40)] + ["ab" * 500, " " * 1000]
    texts += ["".join(draw.choices("abcdeinrst", k=900)) for _ in range(20)]
    want = pieces.encode(texts, num_threads=1)
    assert [np.frombuffer(x, "<i4").tolist() for x in model.encode(texts)] == want
    some = [[draw.choice([1, 2, 3, 70, 131, 200, 230, 259, 300]) for _ in range(6)] for _ in range(500)]
    for lists in (want, [x + [2] for x in want], some):
        bounds = np.cumsum([0] + [len(x) for x in lists])
        flat = np.array([i for x in lists for i in x], np.int64)
        assert model.decode_all(flat, bounds) == [pieces.decode(x) for x in lists]


def test_merge_one_equals_rounds():
    model = piece_bpe.PieceModel(MODEL)
    words = ["▁" + "".join(random.Random(i).choices("aeinrst", k=200)) for i in range(50)]
    symbols, counts = model.merge(words)
    at = np.cumsum(np.r_[0, counts])
    for i, word in enumerate(words):
        assert symbols[at[i] : at[i + 1]].tolist() == model.merge_one(word)


def test_piece_frame(spark, pieces):
    found = piece_bpe.encode_frame(clashing(spark), MODEL)
    assert found.columns.count("ids") == 1
    for r in found.collect():
        assert r["ids"] == pieces.encode(r["text"] or "") + [2]
        assert r["decoded"] == pieces.decode(pieces.encode(r["text"] or ""))
    assert piece_bpe.encode_frame(docs(spark, []), MODEL).count() == 0


def test_counts(spark, library, pieces):
    found = token_counts.count_tokens(clashing(spark), JSON, limit=30).collect()
    assert len(found) == len(ROWS)
    for r in found:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (
            n, len((r["text"] or "").encode()), n > 30,
        )
    small = docs(spark).select("text", token_counts.n_tokens("text", JSON, 1000).alias("n"))
    for r in small.collect():  # long texts in many pieces
        assert r["n"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    for r in docs(spark).select("text", token_counts.n_tokens("text", MODEL).alias("n")).collect():
        assert r["n"] == len(pieces.encode(r["text"] or ""))
    assert token_counts.count_tokens(docs(spark, []), JSON).count() == 0


def test_packing(spark, library):
    found = packing.pack(clashing(spark), JSON, 2, size=64, keep_ids=True).cache()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found.collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    ids = defaultdict(list)
    for key, text in ROWS:
        ids[key].append(library.encode(text or "", add_special_tokens=False).ids + [2])
    for key, lists in ids.items():
        assert sum(r["length"] for r in by_doc[key]) == sum(map(len, lists))
        if len(lists) == 1:
            rows = sorted(by_doc[key], key=lambda r: r["piece"])
            assert [r["piece"] for r in rows] == list(range(len(rows)))
            assert len(rows) == -(-len(lists[0]) // 64)
            for r in rows:
                part = lists[0][r["start"] : r["start"] + r["length"]]
                assert np.frombuffer(r["ids"], "<u4").tolist() == part
                assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    total = sum(len(x) for lists in ids.values() for x in lists)
    assert len(by_sequence) <= total // 64 + 2
    made = {r["sequence_id"]: r for r in packing.sequences(found).collect()}
    for name, rows in by_sequence.items():
        raw = b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["offset"]))
        assert bytes(made[name]["ids"]) == raw and made[name]["length"] == len(raw) // 4
    assert packing.pack(docs(spark, []), JSON, 2).count() == 0


def test_plan_covers_every_slot_once():
    draw = random.Random(4)
    for _ in range(30):
        counts = {draw.randint(1, 100): draw.randint(1, 300) for _ in range(draw.randint(1, 100))}
        held: dict[int, list] = defaultdict(list)
        taken = dict.fromkeys(counts, 0)
        for length, low, slots, first, n, offset in sorted(packing.plan(counts, 100)):
            assert low == taken[length] and slots % n == 0
            taken[length] += slots
            for s in range(slots):
                held[first + s % n].append((offset + length * (s // n), length))
        assert taken == counts
        assert sorted(held) == list(range(len(held)))
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 100


def test_plan_equals_best_fit_item_by_item():
    draw = random.Random(6)
    for _ in range(40):
        counts = {draw.randint(1, 50): draw.randint(1, 40) for _ in range(12)}
        rooms: list[int] = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                best = min((r for r in rooms if r >= length), default=None)
                if best is None:
                    rooms.append(50 - length)
                else:
                    rooms.remove(best)
                    rooms.append(best - length)
        assert max(x[3] + x[4] for x in packing.plan(counts, 50)) == len(rooms)


def test_token_files(spark, library):
    folder = shared_path(spark, "files")
    token_files.write(clashing(spark), JSON, folder, 2)
    found = token_files.read(spark, folder).orderBy("start").collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in found] == [r[0] for r in rows]
    at = 0
    for r, (_, text) in zip(found, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        if r["doc_id"] is not None and r["doc_id"] != 9:
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["start"] == at
        at += r["n_tokens"]
    empty = shared_path(spark, "files")
    token_files.write(docs(spark, []), JSON, empty, 2)
    assert token_files.read(spark, empty).count() == 0
    assert found[0].asDict().keys() == {"doc_id", "start", "n_tokens", "ids"}


def test_files_are_flat(spark):
    folder = shared_path(spark, "files")
    token_files.write(docs(spark), JSON, folder, 2)
    lines = spark.read.schema(token_files.MANIFEST + ", base long").json(f"{folder}/manifest.json")
    base = 0
    for line in lines.orderBy("part").collect():
        assert line["base"] == base
        ids = np.fromfile(f"{folder}/{line['name']}.ids".removeprefix("file:"), "<u2")
        offsets = np.fromfile(f"{folder}/{line['name']}.offsets".removeprefix("file:"), "<u8")
        assert len(ids) == line["n_tokens"] == offsets[-1] and len(offsets) == line["n_docs"] + 1
        base += line["n_tokens"]
    assert base == token_files.read(spark, folder).agg(F.sum("n_tokens")).first()[0]
