"""Alignment of the tokens of two tokenizers over the same bytes, and counts of id pairs.

Tokenizer A is a byte-level ``tokenizers`` file, fed a blank and the text; B a sentencepiece
model, fed the text (it puts the blank there itself).  A text whose tokens' bytes are not
the blank and the text, on either side, has no tokens.

Overlaps come from two ``pandas.merge_asof`` per batch, keyed by document: each token's
start finds the token of the other side that covers it.  The union of both directions holds
every pair of tokens that share a byte.  Where the tokens of a pair end at the same byte, a
group ends; tokens of one group are linked.  Groups with one token on a side are their
overlaps; in the others the distinct ids of both sides are paired, with their numbers of
occurrences, so a group is never spelled out pair by pair.

A batch of documents is a block.  Its distinct segments are encoded once; its tokens are
made, aligned, counted and written out in parts of bounded size, cut between segments (where
both sides' tokens end), so that a part may end within a document.  What a block leaves
are small rows, one for each document, with its pairs as places in the block's list of
distinct pairs, and that list with the documents that hold each, some thousand pairs a row.
No cell grows with the block, in the JVM or in Python: whole blocks as cells took executors
beyond their memory on large inputs, as a scan holds many rows of a table at once.

Only the lists are added up by pair, the highest count of an A id is found among its pairs
(at most B's vocabulary), and both go back to the blocks by pair, hot ones in place.  There
the documents of a block meet its list, which is as long as it was in the batch that made it.

Results for special rows: null and empty texts have no tokens, zeros and no groups; equal
texts are aligned one by one, and each is a document in the counts, as are rows with equal
keys; a null key stays null; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import word_encoder
from .common import attach, bound_batches, settled, slices

#: Bits of a B id in a pair, and of an A id.
B_BITS, A_BITS = 20, 24
#: Fixed value: how byte-level files of this kind cut a text before any merge.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>\Z")


def byte_alphabet() -> dict[str, int]:
    """The bytes behind the characters of byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes in order for those from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: The blank between two segments: one behind a character that is no white space, with
#: something behind it.  Tokens of both kinds end before it, so the segments of a text can
#: be encoded apart.
_BETWEEN = re.compile(r"(?<=\S) (?!\Z)")
_BEHIND_SPACE = re.compile(r"\s ")
#: Characters of segments that are encoded as one text.
AT_ONCE = 20_000


def segments(text: str) -> list[str]:
    """A text cut at the blanks where a token must end, without these blanks."""
    if text[0] == " " or text[-1] == " " or _BEHIND_SPACE.search(text):
        return _BETWEEN.split(text)
    return text.split(" ")


@dataclass
class Encoded:
    """Ids of segments: where those of each begin, how many there are, and whether their
    bytes are not the blank and the segment."""

    ids: np.ndarray
    begin: np.ndarray
    count: np.ndarray
    bad: np.ndarray


class Side:
    """A tokenizer: ids of segments with a blank before them, and the bytes of its tokens."""

    bytes: list[bytes]
    lengths: np.ndarray

    def encode_all(self, text: str) -> list[int]:
        """Ids of a text that a blank is put before."""
        raise NotImplementedError

    def encode(self, keys: list[str], together: list[Together], alone: list[int]) -> Encoded:
        """Ids of segments: those in ``together`` many at once, their ids dealt by their
        bytes; if these are not the text's, each is encoded alone."""
        lists: list[np.ndarray] = []
        begin, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        bad = np.zeros(len(keys), bool)
        done, rest = 0, list(alone)
        for group in together:
            ids = self.encode_all(group.text)
            if b"".join(map(self.bytes.__getitem__, ids)) != b" " + group.text.encode():
                rest.extend(group.places.tolist())
                continue
            ids = np.array(ids, np.int64)
            ends = np.cumsum(self.lengths[ids])
            last = np.searchsorted(ends, group.stops)
            if not np.array_equal(ends[last], group.stops):
                rest.extend(group.places.tolist())
                continue
            begin[group.places[0]] = done
            begin[group.places[1:]] = done + last[:-1] + 1
            count[group.places] = np.diff(last, prepend=-1)
            lists.append(ids)
            done += len(ids)
        for i in rest:
            ids = np.array(self.encode_all(keys[i]), np.int64)
            spelled = b"".join(map(self.bytes.__getitem__, ids.tolist()))
            begin[i], count[i], bad[i] = done, len(ids), spelled != b" " + keys[i].encode()
            lists.append(ids)
            done += len(ids)
        return Encoded(np.concatenate(lists) if lists else np.zeros(0, np.int64), begin, count, bad)


@dataclass
class Together:
    """Segments that are encoded as one text: their numbers, and where their bytes end."""

    text: str
    places: np.ndarray
    stops: np.ndarray


def grouped(keys: list[str]) -> tuple[list[Together], list[int]]:
    """Segments to be encoded as one text; and those that may run into the next one, alone."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
    open_end = np.fromiter((k[-1:].isspace() or not k for k in keys), bool, len(keys))
    places = np.flatnonzero(~open_end)
    number = np.cumsum(sizes[places]) // AT_ONCE
    found = []
    for part in np.split(places, np.flatnonzero(np.diff(number)) + 1) if len(places) else []:
        mine = [keys[i] for i in part.tolist()]
        text = " ".join(mine)
        wide = not text.isascii()
        lengths = [len(k.encode()) + 1 for k in mine] if wide else sizes[part]
        found.append(Together(text, part, np.cumsum(lengths)))
    return found, np.flatnonzero(open_end).tolist()


class ByteTokens(Side):
    """Ids and bytes of a byte-level ``tokenizers`` file; special strings are plain text.

    A file whose merges stand in the order of their ids is a table of ranks, which
    ``tiktoken`` encodes by, several times as fast.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        model = spec["model"]
        names: dict[int, str] = {i: name for name, i in model["vocab"].items()}
        names |= {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.bytes = [
            bytes(alphabet[c] for c in names[i]) if all(c in alphabet for c in names[i]) else names[i].encode()
            for i in range(len(names))
        ]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        before = spec.get("pre_tokenizer") or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranked = all(model["vocab"].get("".join(p)) == 256 + i for i, p in enumerate(pairs))
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not spec.get("normalizer")
        if ranked and plain and not before.get("add_prefix_space", True) and not model.get("ignore_merges"):
            import tiktoken

            ranks = {bytes(alphabet[c] for c in name): i for name, i in model["vocab"].items()}
            library = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode_all = lambda text: library.encode_ordinary(" " + text)
        else:
            library = word_encoder.encoder(path, ordinary=True).library
            self.encode_all = lambda text: library.encode(" " + text, add_special_tokens=False).ids


class PieceTokens(Side):
    """Ids and bytes of a sentencepiece model, which puts the blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            byte = _BYTE_PIECE.match(piece) if library.is_byte(i) else None
            self.bytes.append(
                bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()
            )
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        if any(" " in b.lstrip(b" ").decode("utf-8", "replace") for b in self.bytes):
            raise ValueError("the model has pieces that go over blanks")
        self.encode_all = library.encode


_SIDES: dict = {}


def _side(kind, path: str):
    if (kind, path) not in _SIDES:
        _SIDES[kind, path] = kind(path)
    return _SIDES[kind, path]


@dataclass
class Tokens:
    """Tokens of a batch, one side: ids, document, and the bytes they cover; documents lie
    behind each other."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray


def _tokens(keys: np.ndarray, doc: np.ndarray, n_docs: int, known: Encoded, lengths) -> Tokens:
    """Tokens of documents, given as segments (numbers of keys, and documents)."""
    many = known.count[keys]
    stops = np.cumsum(many)
    total = int(stops[-1]) if len(stops) else 0
    found = known.ids[np.repeat(known.begin[keys] - (stops - many), many) + np.arange(total)]
    end = np.cumsum(lengths[found])
    of = np.repeat(doc, many)
    return Tokens(found, of, end - lengths[found], end, np.bincount(of, minlength=n_docs))


def covering(starts: Tokens, others: Tokens) -> np.ndarray:
    """For each token of ``starts`` the token of ``others`` that covers its start."""
    left = pd.DataFrame({"doc": starts.doc, "at": starts.start})
    right = pd.DataFrame({"doc": others.doc, "at": others.start, "place": np.arange(len(others.ids))})
    return pd.merge_asof(left, right, on="at", by="doc")["place"].to_numpy(np.int64)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens that share a byte, in no order."""
    from_a, from_b = covering(a, b), covering(b, a)
    # a pair found from both sides starts at the same byte on both
    more = np.flatnonzero(a.start[from_b] != b.start)
    return (
        np.concatenate([np.arange(len(a.ids)), from_b[more]]),
        np.concatenate([from_a, more]),
    )


@dataclass
class Aligned:
    """Groups of a batch: numbers of the groups of both sides' tokens, sizes, documents."""

    of_a: np.ndarray
    of_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    doc: np.ndarray


def aligned(a: Tokens, b: Tokens, left: np.ndarray, right: np.ndarray) -> Aligned:
    """Groups between the ends that both sides share."""
    same = a.end[left] == b.end[right]
    ends_a, ends_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    ends_a[left[same]] = 1
    ends_b[right[same]] = 1
    of_a, of_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    last_a, last_b = np.flatnonzero(ends_a), np.flatnonzero(ends_b)
    return Aligned(
        of_a, of_b, np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1), a.doc[last_a]
    )


def _tally(ids: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, occurrences) in order."""
    found, n = np.unique(group << bits | ids, return_counts=True)
    return found >> bits, found & ((1 << bits) - 1), n


def _wide_pairs(a: Tokens, b: Tokens, g: Aligned, wide: np.ndarray) -> tuple:
    """(document, pair, links) of groups with several tokens on both sides."""
    in_a, in_b = wide[g.of_a], wide[g.of_b]
    group_a, id_a, times_a = _tally(a.ids[in_a], g.of_a[in_a], A_BITS)
    group_b, id_b, times_b = _tally(b.ids[in_b], g.of_b[in_b], B_BITS)
    first = np.searchsorted(group_b, group_a)
    many = np.searchsorted(group_b, group_a, side="right") - first
    row = np.repeat(np.arange(len(group_a)), many)
    other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
    return g.doc[group_a[row]], id_a[row] << B_BITS | id_b[other], times_a[row] * times_b[other]


def _added(key: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their links."""
    key, at = np.unique(key, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, links)
    return key, total


def linked(a: Tokens, b: Tokens, left: np.ndarray, right: np.ndarray, g: Aligned) -> tuple:
    """(document and pair as one number, links): distinct pairs of ids linked in a document,
    in order."""
    bits = A_BITS + B_BITS
    wide = (g.n_a > 1) & (g.n_b > 1)
    if wide.any():
        plain = ~wide[g.of_a[left]]
        left, right = left[plain], right[plain]
    key, links = np.unique(
        a.doc[left] << bits | a.ids[left] << B_BITS | b.ids[right], return_counts=True
    )
    if wide.any():
        doc, pair, more = _wide_pairs(a, b, g, wide)
        return _added(np.concatenate([key, doc << bits | pair]), np.concatenate([links, more]))
    return key, links


def _write(a: Tokens, b: Tokens, g: Aligned, names: tuple[list[bytes], list[bytes]], hashes: dict) -> None:
    """The groups of a part, written out, added to the SHA-256 of each document in it."""
    wide = len(names[0]) // 2
    # an id with the separator behind it: a comma within a side, else what closes the side
    last_a = np.append(g.of_a[1:] != g.of_a[:-1], True) if len(a.ids) else np.zeros(0, bool)
    last_b = np.append(g.of_b[1:] != g.of_b[:-1], True) if len(b.ids) else np.zeros(0, bool)
    code = np.empty(len(a.ids) + len(b.ids), np.int64)
    code[np.arange(len(a.ids)) + (np.cumsum(g.n_b) - g.n_b)[g.of_a]] = a.ids + wide * last_a
    code[np.arange(len(b.ids)) + np.cumsum(g.n_a)[g.of_b]] = b.ids + wide * (2 + last_b)
    table = names[0] + names[1]
    texts = list(map(table.__getitem__, code.tolist()))
    many, begin = a.counts + b.counts, 0
    for doc in np.flatnonzero(many).tolist():
        end = begin + int(many[doc])
        spelled = b"".join(texts[begin:end])[:-1]
        if doc in hashes:
            hashes[doc].update(b";" + spelled)
        else:
            hashes[doc] = hashlib.sha256(spelled)
        begin = end


_NAMES: dict = {}


def _names(side_a, side_b) -> tuple[list[bytes], list[bytes]]:
    """Decimal ids with the separators behind them, each side padded to one width."""
    if "names" not in _NAMES:
        wide = max(len(side_a.bytes), len(side_b.bytes))
        ids = [str(i).encode() for i in range(wide)]
        _NAMES["names"] = (
            [i + b"," for i in ids] + [i + b"|" for i in ids],
            [i + b"," for i in ids] + [i + b";" for i in ids],
        )
    return _NAMES["names"]


@dataclass
class Segmented:
    """Texts as segments: numbers of their keys and their documents, and the ids of the keys
    on both sides.  Texts whose bytes differ, and empty ones, have no segments."""

    keys: np.ndarray
    doc: np.ndarray
    known: tuple[Encoded, Encoded]
    lengths: tuple[np.ndarray, np.ndarray]
    n_docs: int

    def tokens(self, begin: int = 0, end: int | None = None) -> tuple[Tokens, Tokens]:
        """Tokens of a range of segments, both sides."""
        keys, doc = self.keys[begin:end], self.doc[begin:end]
        one, two = (
            _tokens(keys, doc, self.n_docs, found, lengths)
            for found, lengths in zip(self.known, self.lengths, strict=True)
        )
        return one, two

    def parts(self, most: int) -> Iterator[tuple[int, int]]:
        """Ranges of segments of about ``most`` tokens of both sides, one segment at least."""
        many = np.cumsum((self.known[0].count + self.known[1].count)[self.keys])
        begin = done = 0
        while begin < len(many):
            end = max(begin + 1, int(np.searchsorted(many, done + most, side="right")))
            yield begin, end
            begin, done = end, many[end - 1]


def segmented(texts: list[str], side_a: Side, side_b: Side) -> Segmented:
    """Every distinct segment of the texts is encoded once."""
    cut = [segments(t) if t else [] for t in texts]
    sizes = np.array([len(c) for c in cut], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    every = list(chain.from_iterable(cut))
    place = {key: i for i, key in enumerate(dict.fromkeys(every))}
    keys = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
    names = list(place)
    together, alone = grouped(names)
    one, two = (side.encode(names, together, alone) for side in (side_a, side_b))
    bad = one.bad | two.bad
    if bad.any():
        spoilt = np.zeros(len(texts), bool)
        spoilt[doc[bad[keys]]] = True
        keys, doc = keys[~spoilt[doc]], doc[~spoilt[doc]]
    return Segmented(keys, doc, (one, two), (side_a.lengths, side_b.lengths), len(texts))


def encoded(texts: list[str], side_a: Side, side_b: Side) -> tuple[Tokens, Tokens]:
    """Tokens of both sides; none for empty texts and those whose bytes differ."""
    return segmented(texts, side_a, side_b).tokens()


#: Tokens of both sides that are aligned at once.
PART_TOKENS = 200_000


@dataclass
class Block:
    """What the alignment of some documents leaves: columns of numbers and hashes by
    document, distinct (document, pair) in order with their links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    shas: list[str]
    doc: np.ndarray
    pair: np.ndarray
    links: np.ndarray


def block_of(texts: list[str], side_a: Side, side_b: Side, most: int = PART_TOKENS) -> Block:
    """The documents aligned, a part after the other."""
    n, bits = len(texts), A_BITS + B_BITS
    names = _names(side_a, side_b)
    whole = segmented(texts, side_a, side_b)
    counts = np.zeros((4, n), np.int64)
    hashes: dict = {}
    keys, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, end in whole.parts(most):
        a, b = whole.tokens(begin, end)
        left, right = overlaps(a, b)
        g = aligned(a, b, left, right)
        key, times = linked(a, b, left, right, g)
        keys.append(key)
        links.append(times)
        counts[0] += a.counts
        counts[1] += b.counts
        counts[2] += np.bincount(g.doc, minlength=n)
        np.add.at(counts[3], g.doc, g.n_a * g.n_b)
        _write(a, b, g, names, hashes)
    key, times = _added(np.concatenate(keys), np.concatenate(links))
    shas = [hashes[i].hexdigest() if i in hashes else "" for i in range(n)]
    return Block(*counts, shas, key >> bits, key & ((1 << bits) - 1), times)


#: Pairs of a block's list in one row.
LIST_ROWS = 4096
#: A document has ``key``, its numbers, its hash, and its pairs as places and links; a piece
#: of a block's list has the place of its first pair, pairs and documents that hold them.
BLOCK = (
    "block long, key {key}, n_a long, n_b long, n_groups long, n_links long, sha string, "
    "places binary, links binary, first long, pairs array<long>, docs array<long>"
)


def packed(values: np.ndarray, most: int) -> bytes:
    """Numbers up to ``most`` in as few bytes each as hold it; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _rows(block: int, key: pa.Array, made: Block) -> Iterator[dict]:
    """Columns of a block's rows: its documents, and its list in pieces."""
    values, places = np.unique(made.pair, return_inverse=True)
    ends = np.cumsum(np.bincount(made.doc, minlength=len(key)))[:-1]
    yield {
        "block": np.full(len(key), block),
        "key": key,
        "n_a": made.n_a,
        "n_b": made.n_b,
        "n_groups": made.n_groups,
        "n_links": made.n_links,
        "sha": made.shas,
        "places": [packed(x, len(values)) for x in np.split(places, ends)],
        "links": [packed(x, int(x.max(initial=0))) for x in np.split(made.links, ends)],
    }
    docs = np.bincount(places, minlength=len(values))
    first = np.arange(0, len(values), LIST_ROWS)
    if len(first):
        yield {
            "block": np.full(len(first), block),
            "first": first,
            "pairs": np.split(values, first[1:]),
            "docs": np.split(docs, first[1:]),
        }


def _blocks(path_a: str, path_b: str, schema: pa.Schema):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        side_a, side_b = _side(ByteTokens, path_a), _side(PieceTokens, path_b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, at = batch.column("key"), 0
            for texts in slices(batch.column("text")):
                n = len(texts)
                for row in _rows(block, keys.slice(at, n), block_of(texts, side_a, side_b)):
                    many = len(row["block"])
                    arrays = []
                    for f in schema:
                        if f.name not in row:
                            arrays.append(pa.nulls(many, f.type))
                        elif isinstance(row[f.name], pa.Array):
                            arrays.append(row[f.name].cast(f.type))
                        else:
                            arrays.append(pa.array(row[f.name], f.type))
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)
                block, at = block + 1, at + n

    return made


RESULT = (
    "{name} {key}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def _results(schema: pa.Schema):
    def found(docs: pa.Table, counted: pa.Table) -> pa.Table:
        """The documents of a block, and its list as (at, count, best)."""
        at = counted.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at] = counted.column("count").to_numpy()
        best[at] = counted.column("best").to_numpy()
        weight = np.zeros((2, len(docs)), np.int64)
        for i, (held, links) in enumerate(
            zip(docs.column("places").to_pylist(), docs.column("links").to_pylist(), strict=True)
        ):
            held, links = unpacked(held), unpacked(links)
            weight[0, i] = links @ best[held]
            weight[1, i] = links @ count[held]
        columns = [
            *map(docs.column, ("key", "n_a", "n_b", "n_groups", "n_links")),
            pa.chunked_array([weight[0]]), pa.chunked_array([weight[1]]), docs.column("sha"),
        ]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return found


def blocks(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The aligned documents of ``df`` and the lists of their blocks, as a written table."""
    bound_batches()
    schema = BLOCK.format(key=df.schema[key].dataType.simpleString())
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return settled(rows.mapInArrow(_blocks(path_a, path_b, arrow), schema), "aligned")


def pair_counts(aligned_blocks: DataFrame) -> DataFrame:
    """(pair, count, blocks, best): documents that hold a pair linked, and whether no pair
    of its A id is held by more; a written table."""
    lists = aligned_blocks.where(F.col("pairs").isNotNull())
    each = lists.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = settled(
        each.groupBy(F.col("p.pairs").alias("pair")).agg(
            F.sum("p.docs").alias("count"), F.count(F.lit(1)).alias("blocks")
        ),
        "pairs",
    )
    of_a = F.shiftright("pair", B_BITS)
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("most"))
    # an A id has at most as many pairs as B has ids
    return settled(
        counts.join(highest, of_a == F.col("a")).select(
            "pair", "count", "blocks", (F.col("count") == F.col("most")).alias("best")
        ),
        "counts",
    )


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    made = blocks(df, path_a, path_b, key, text)
    counts = pair_counts(made)
    lists = made.where(F.col("pairs").isNotNull())
    listed = lists.select("block", "first", F.posexplode("pairs").alias("at", "pair")).select(
        "block", (F.col("first") + F.col("at")).alias("at"), "pair"
    )
    value = F.struct("count", F.col("best").cast("long").alias("best"))
    met = attach(listed, counts, "pair", "blocks", ["block", "at"], value, "of")
    known = met.select(F.col("block").alias("of_block"), "at", "of.count", "of.best")
    docs = made.where(F.col("pairs").isNull()).drop("first", "pairs", "docs")
    schema = RESULT.format(name=f"`{key}`", key=df.schema[key].dataType.simpleString())
    found = _results(to_arrow_schema(StructType.fromDDL(schema)))
    # a block's documents and its list are no more than the batch that made them
    return docs.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(found, schema)
