"""Every registered query without SQL over the whole documents, column by column, against
the libraries and brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilframe.llm import queries

END = 2


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def ids(documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    keys = sorted(documents)
    found = library.encode_batch([documents[k] for k in keys], add_special_tokens=False)
    return {k: e.ids for k, e in zip(keys, found, strict=True)}


def rows_of(spark, sf_dir, name, key="doc_id"):
    found = queries.QUERIES[name](spark, sf_dir).collect()
    return found


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, sf_dir, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, sf_dir, "op3_best_fit_packing"):
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    total = 0
    for doc, tokens in ids.items():
        mine, whole = sorted(by_doc[doc], key=lambda r: r["piece"]), [*tokens, END]
        total += len(whole)
        assert [r["piece"] for r in mine] == list(range(-(-len(whole) // 1024)))
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == crc(whole[at : at + r["length"]])
            assert r["length"] == 1024 or r["piece"] == 0
            at += r["length"]
        assert at == len(whole)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_sequence) <= 1.02 * total / 1024 + 1


def test_sharding(spark, sf_dir, documents):
    shards, slots, places = Counter(), defaultdict(list), defaultdict(set)
    rows = rows_of(spark, sf_dir, "op4_sharding")
    assert len(rows) == len(documents)
    for r in rows:
        raw = documents[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        shards[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        places[raw].add(r["shard"])
    assert all(len(x) == 1 for x in places.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len(shards) == 16 and max(shards.values()) <= 1.01 * min(shards.values())


KINDS = ["email", "ip", "card", "phone"]
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data(spark, sf_dir, documents):
    found = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op5_pii_votes")}
    assert found.keys() == documents.keys()
    for doc, text in documents.items():
        spans = {
            k: [m.span() for m in re.finditer(SHAPES[k], text) if holds(k, m[0])] for k in KINDS
        }
        r = found[doc]
        assert [r[f"n_{k}"] for k in KINDS] == [len(spans[k]) for k in KINDS]
        base = [f"{k}:{b}:{e}" for k in KINDS for b, e in spans[k]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        mine = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(mine)
        assert all(int(x.split(":")[1]) < int(x.split(":")[2]) <= len(text) for x in mine)


def test_token_files(spark, sf_dir, ids):
    rows = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op6_token_files")}
    assert rows.keys() == ids.keys()
    start = 0
    for doc in sorted(ids):
        whole = [*ids[doc], END]
        assert (rows[doc]["start"], rows[doc]["n_tokens"]) == (start, len(whole))
        assert rows[doc]["ids_crc32"] == crc(whole)
        start += len(whole)


def test_piece_encoding(spark, sf_dir, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = rows_of(spark, sf_dir, "op8_piece_bpe")
    assert len(rows) == len(documents)
    for r in rows:
        whole = [*library.encode(documents[r["doc_id"]]), END]
        assert r["n_tokens"] == len(whole)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, whole)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(whole).encode()).hexdigest()


def test_token_counts(spark, sf_dir, documents, ids):
    rows = rows_of(spark, sf_dir, "op9_token_counts")
    assert len(rows) == len(documents)
    for r in rows:
        n = len(ids[r["doc_id"]])
        assert r["n_bytes"] == len(documents[r["doc_id"]].encode())
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 512)


def base_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = [any(windows[tuple(words[j : j + 3])] > 1 for j in range(max(0, i - 2), i + 1) if j + 3 <= len(words)) for i in range(len(words))]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), sum(again),
    )


def test_quality(spark, sf_dir, documents):
    rows = rows_of(spark, sf_dir, "op10_quality_rules")
    assert len(rows) == len(documents)
    for r in rows:
        base = base_of(documents[r["doc_id"]])
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        assert tuple(r[n] for n in names) == base
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
