"""SentencePiece encoding and decoding by vectorised merge rounds.

A model of the BPE kind with an identity normaliser is read from its file.  All words of a
batch that are new lie in flat numpy arrays, one symbol after the other.  A round finds
the best pair of every word (a segmented minimum over pair ranks), merges its occurrences
from the left at once, and compacts the arrays; words without a pair leave.  Rounds go on
until no word is left.

The library merges one pair at a time, and a merge can create a pair that ranks above the
next occurrence of the same pair.  Where that would happen, the word merges only its
leftmost occurrence in that round, so the ids are the library's in every case.

A word is a run of word marks with the characters up to the next mark; the model's pieces
hold marks only at their start (checked when the file is read), so no merge crosses.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, spread_free

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format
NONE = np.iinfo(np.int64).max
CODES = 0x110000
KEPT_WORDS = 400_000
LONG_WORD = 48
#: Words longer than this are merged one by one with a heap: rounds follow the number of
#: different merges, which in a long word may be thousands.
HEAP_FROM = 400
#: Ids that are decoded at once.
IDS_AT_ONCE = 500_000
WORD = re.compile(f"{MARK}+[^{MARK}]*")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


class PieceModel:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        texts: list[str] = []
        scores: list[float] = []
        types: list[int] = []
        trainer: dict = {}
        normaliser: dict = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                types.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        normal = [t in (NORMAL, UNUSED) for t in types]
        if (
            trainer.get(3, 1) != 2
            or normaliser.get(2, b"")
            or not normaliser.get(3, 1)
            or normaliser.get(4, 1)
            or not normaliser.get(5, 1)
            or trainer.get(24, 0)
            or not trainer.get(35, 0)
            or USER in types
            or UNUSED in types
            or any(re.search(f"[^{MARK}]{MARK}", t) for t, n in zip(texts, normal) if n)
        ):
            raise ValueError(
                "expected a BPE model with byte fallback, identity normaliser, a word mark "
                "put in front, kept white space, marks at the start of pieces, and no user pieces"
            )
        self.size = len(texts)
        self.end = int(trainer.get(42, 2))
        ids = {t: i for i, t in enumerate(texts) if normal[i]}
        self.byte_ids = [0] * 256
        for i, t in enumerate(texts):
            if types[i] == BYTE:
                self.byte_ids[int(t[3:5], 16)] = i

        def symbol(t: str) -> int | None:
            return ids.get(t, self.size + ord(t) if len(t) == 1 else None)

        self.one = {t: i for t, i in ids.items() if len(t) == 1}
        #: Of equal scores the left one goes first, so they share a rank.
        order = sorted({scores[i] for i in ids.values()}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        self.rank = np.full(self.size + 1, NONE, np.int64)
        pairs: dict[int, int] = {}
        self.width = self.size + CODES
        for t, i in ids.items():
            self.rank[i] = place[scores[i]]
            for cut in range(1, len(t)):
                left, right = symbol(t[:cut]), symbol(t[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.line_end_is_free = not any("\n" in t and len(t) > 1 for t in ids)
        #: Symbol of every code point.
        self.symbols = np.arange(self.size, self.width, dtype=np.int64)
        for t, i in self.one.items():
            self.symbols[ord(t)] = i
        spelled = [t.replace(MARK, " ").encode() for t in texts]
        self.spelled = [
            bytes([int(t[3:5], 16)]) if types[i] == BYTE
            else b"" if types[i] == CONTROL
            else " ⁇ ".encode() if types[i] == UNKNOWN
            else spelled[i]
            for i, t in enumerate(texts)
        ]
        self.is_byte = np.array([t == BYTE for t in types])
        self.is_control = np.array([t == CONTROL for t in types])
        self.marked = [t.startswith(MARK) and types[i] == NORMAL for i, t in enumerate(texts)]
        self.marked = np.array(self.marked)
        self.flat = np.frombuffer(b"".join(self.spelled) + b" ", np.uint8)
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.known: dict[str, bytes] = {}

    # --- words ------------------------------------------------------------------------

    def words_of(self, text: str) -> list[str]:
        """Keys of the words of a text: the first mark is left out, and a key that starts
        with a line end stands for itself, without a mark in front."""
        if not text:
            return []
        if (
            self.line_end_is_free
            and text[0] not in " \n"
            and "  " not in text
            and " \n" not in text
            and MARK not in text
        ):
            return text.replace("\n", " \n").split(" ")
        words = [w[1:] for w in WORD.findall(MARK + text.replace(" ", MARK))]
        # a line end behind a mark would look like one without: it gets a blank in front
        return [" " + w if w[:1] == "\n" else w for w in words]

    @staticmethod
    def spelling(word: str) -> str:
        if word[:1] == "\n":
            return word
        return MARK + word.removeprefix(" ")

    # --- merge rounds -----------------------------------------------------------------

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair merges into, ``size`` for none."""
        wanted = left * self.width + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.merged[at], self.size)

    def merge(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, one word after the other, and the number per word."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4")
        symbol = self.symbols[codes]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        into = self._pairs(symbol, word)
        while len(symbol):
            rank = self.rank[into]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.r_[starts, len(word)]))
            over = best == NONE
            if over.any():
                done.append((word[over], symbol[over]))
                symbol, word, into, rank, best = (
                    x[~over] for x in (symbol, word, into, rank, best)
                )
                if not len(symbol):
                    break
            chosen = self._leftmost(rank == best)
            chosen = self._one_where_order_matters(symbol, word, into, best, chosen)
            at = np.flatnonzero(chosen)
            symbol[at] = into[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            place = np.cumsum(keep)[at] - 1
            symbol, word, into = symbol[keep], word[keep], into[keep]
            # only pairs with a merged symbol are new
            changed = np.zeros(len(symbol), bool)
            changed[place] = changed[np.maximum(place - 1, 0)] = True
            fresh = np.flatnonzero(changed)
            into[fresh] = self.size
            inner = fresh[fresh < len(symbol) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            into[inner] = self.look_up(symbol[inner], symbol[inner + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner = np.concatenate([w for w, _ in done])
        symbols = np.concatenate([s for _, s in done])
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _pairs(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        into = np.full(len(symbol), self.size, np.int64)
        if len(symbol) > 1:
            inside = np.flatnonzero(word[1:] == word[:-1])
            into[inside] = self.look_up(symbol[inside], symbol[inside + 1])
        return into

    @staticmethod
    def _leftmost(best: np.ndarray) -> np.ndarray:
        """Of neighbouring candidates every second, from the left."""
        index = np.arange(len(best))
        first = best & ~np.r_[False, best[:-1]]
        run = np.maximum.accumulate(np.where(first, index, 0))
        return best & ((index - run) % 2 == 0)

    def _one_where_order_matters(
        self,
        symbol: np.ndarray,
        word: np.ndarray,
        into: np.ndarray,
        best: np.ndarray,
        chosen: np.ndarray,
    ) -> np.ndarray:
        """Leaves one merge to a word in which a merge makes a pair as good as its own."""
        at = np.flatnonzero(chosen)
        own = word[at]
        many = (np.r_[own[1:] == own[:-1], False]) | (np.r_[False, own[1:] == own[:-1]])
        some = at[many]
        if not len(some):
            return chosen
        n = len(symbol)
        late = np.zeros(len(some), bool)
        # the pair with the symbol to the right, as it was
        right = some + 2
        ok = (right < n) & (word[np.minimum(right, n - 1)] == word[some])
        made = self.look_up(into[some[ok]], symbol[right[ok]])
        late[ok] |= self.rank[made] <= best[some[ok]]
        # the pair with the symbol to the left, as it has become
        left = some - 1
        ok = (left >= 0) & (word[np.maximum(left, 0)] == word[some])
        two = np.maximum(some - 2, 0)
        before = np.where((some >= 2) & chosen[two], into[two], symbol[np.maximum(left, 0)])
        made = self.look_up(before[ok], into[some[ok]])
        late[ok] |= self.rank[made] <= best[some[ok]]
        if late.any():
            slow = np.isin(own, word[some[late]])
            first = np.r_[True, own[1:] != own[:-1]]
            chosen = chosen.copy()
            chosen[at[slow & ~first]] = False
        return chosen

    def merge_one(self, word: str) -> list[int]:
        """The same for one long word, with a heap of pairs."""
        symbol = [self.one.get(c, self.size + ord(c)) for c in word]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                piece = self.pairs.get(symbol[i] * self.width + symbol[j])
                if piece is not None:
                    heapq.heappush(heap, (int(self.rank[piece]), i, symbol[i], symbol[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = self.pairs[left * self.width + right], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbol if s >= 0]

    # --- texts ------------------------------------------------------------------------

    def _ids(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols outside the vocabulary as their bytes."""
        if not (symbols >= self.size).any():
            return symbols
        found: list[int] = []
        for s in symbols.tolist():
            if s < self.size:
                found.append(s)
            else:
                found += [self.byte_ids[b] for b in chr(s - self.size).encode()]
        return np.array(found, np.int64)

    def _new(self, words: Sequence[str]) -> dict[str, bytes]:
        spelled = [self.spelling(w) for w in words]
        long = [i for i, w in enumerate(spelled) if len(w) > HEAP_FROM]
        found = {
            words[i]: self._ids(np.array(self.merge_one(spelled[i]), np.int64)).astype("<i4").tobytes()
            for i in long
        }
        short = [i for i, w in enumerate(spelled) if len(w) <= HEAP_FROM]
        symbols, counts = self.merge([spelled[i] for i in short])
        stops = np.cumsum(counts)
        strange = np.flatnonzero(symbols >= self.size)
        odd = set(np.searchsorted(stops, strange, side="right").tolist())
        raw, begin = symbols.astype("<i4").tobytes(), 0
        for n, (i, stop) in enumerate(zip(short, stops.tolist(), strict=True)):
            found[words[i]] = (
                self._ids(symbols[begin:stop]).astype("<i4").tobytes()
                if n in odd
                else raw[begin * 4 : stop * 4]
            )
            begin = stop
        return found

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of texts as bytes of little-endian 32-bit integers, without end ids."""
        cut = [self.words_of(text) for text in texts]
        known = self.known
        new = self._new(list(set(chain.from_iterable(cut)).difference(known)))
        room = KEPT_WORDS - len(known)
        known.update(new)
        ids = [b"".join(map(known.__getitem__, words)) for words in cut]
        for at, word in enumerate(new):
            if at >= room or len(word) > LONG_WORD:
                del known[word]
        return ids

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of ids[bounds[i]:bounds[i + 1]]: the mark put in front goes, byte pieces
        are read as UTF-8, and a byte that is no part of a character becomes U+FFFD."""
        size = self.lengths[ids]
        at = np.r_[0, np.cumsum(size)]
        out = np.empty(int(at[-1]), np.uint8)
        source, to = self.offsets[ids], at[:-1]
        k = 0
        while len(source):
            more = size > k
            if not more.all():
                source, to, size = source[more], to[more], size[more]
            out[to + k] = self.flat[source + k]
            k += 1
        raw, cuts = out.tobytes(), at[bounds].tolist()
        control = self.is_control[ids]
        inside = control.copy()
        inside[bounds[1:][bounds[1:] > 0] - 1] = False  # an end id ends nothing
        found = []
        lows, stops = bounds[:-1].tolist(), bounds[1:].tolist()
        broken = np.r_[0, np.cumsum(inside)][bounds]
        broken = (broken[1:] > broken[:-1]).tolist()
        for n, (low, stop) in enumerate(zip(lows, stops, strict=True)):
            part = raw[cuts[n] : cuts[n + 1]]
            if broken[n]:
                found.append(self._with_controls(ids[low:stop]))
                continue
            if low < stop and self.marked[ids[low]]:
                part = part[1:]
            found.append(_read(part))
        return found

    def _with_controls(self, ids: np.ndarray) -> str:
        """Control ids are no text, and bytes on their two sides make no character."""
        runs: list[list[bytes]] = [[]]
        first = True
        for i in ids.tolist():
            if self.is_control[i]:
                runs.append([])
            else:
                runs[-1].append(self.spelled[i][int(first and self.marked[i]) :])
                first = False
        return "".join(_read(b"".join(run)) for run in runs)


def _read(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "one_by_one")


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


import codecs  # noqa: E402

codecs.register_error("one_by_one", _one_by_one)

_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _lists(raw: Sequence[bytes]) -> pa.Array:
    stops = np.cumsum([0] + [len(r) >> 2 for r in raw])
    values = pa.Array.from_buffers(pa.int32(), int(stops[-1]), [None, pa.py_buffer(b"".join(raw))])
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), values)


def encoded(text: Column | str, path: str, end: bool = True) -> Column:
    """Ids of a text (null as empty) as ``array<int>``, the end id last if ``end``."""

    bound_batches()

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = model(path)
        tail = np.array([pieces.end] if end else [], "<i4").tobytes()
        for batch in batches:
            raw: list[bytes] = []
            for texts in slices(batch):
                raw += [r + tail for r in pieces.encode(texts)]
            yield _lists(raw)

    return ids(text)


def decoded(ids: Column | str, path: str) -> Column:
    """Text of an ``array<int>`` of ids (null as empty)."""

    bound_batches()

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = model(path)
        for batch in batches:
            flat = batch.values.to_numpy(zero_copy_only=False)
            bounds = batch.offsets.to_numpy()
            texts: list[str] = []
            at = 0
            while at < len(bounds) - 1:  # some ids at once, whole lists
                stop = int(np.searchsorted(bounds, bounds[at] + IDS_AT_ONCE))
                stop = min(max(stop, at + 1), len(bounds) - 1)
                some = flat[bounds[at] : bounds[stop]]
                texts += pieces.decode_all(some, bounds[at : stop + 1] - bounds[at])
                at = stop
            yield pa.array(texts, pa.string())

    return texts(F.coalesce(ids, F.array().cast("array<int>")))


def encode_frame(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` plus ids and decoded; columns of these names are replaced.

    Null and empty texts have the end id alone and decode to the empty text; an empty
    table gives an empty table; equal texts give equal ids.
    """
    own = spread_free("_ids", df.columns)
    found = df.withColumn(own, encoded(F.coalesce(F.col(text), F.lit("")), path))
    return found.withColumn("decoded", decoded(F.col(own), path)).withColumn("ids", F.col(own)).drop(own)
