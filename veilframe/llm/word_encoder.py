"""Token ids of whole texts from a ``tokenizers`` file, one library call for many new words.

A byte-level vocabulary cuts a text before any merge, and never across the place where a
non-space is followed by white space.  Texts are therefore cut at those places ("words":
white space with the characters after it), new words are encoded by the library as one
text, whose ids are dealt back by their lengths in bytes, and the ids of a text are the
joined ids of its words: the same ids as for the text in one piece.  A worker keeps a
bounded number of words; the bound only costs time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np

#: White space as the tokenizer's pattern has it (the Unicode property White_Space).
SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACES = frozenset(SPACE)
#: White space with the non-space after it, or white space at the end of the text.
WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+$")
#: White space other than a blank or a line end.
ODD_SPACE = re.compile(f"[{SPACE.replace(' ', '').replace(chr(10), '')}]")
#: Words a worker keeps, and the longest of them.
KEPT_WORDS = 400_000
LONG_WORD = 48
#: Characters per text handed to the library.
AT_ONCE = 1_000


def words_of(text: str) -> list[str]:
    """The text in words, as keys: a word that starts with white space is itself, one that
    starts otherwise stands for a blank and the word, one behind a NUL stands alone."""
    if (
        not text
        or text[0] in " \n"
        or text[-1] in " \n"
        or "  " in text
        or "\n\n" in text
        or " \n" in text
        or "\n " in text
        or "\0" in text
        or ODD_SPACE.search(text)
    ):
        return [
            "\0" + w
            if w[0] not in SPACES or w[-1] in SPACES
            else w[1:]
            if w[0] == " " and w[1] not in SPACES and w[1] != "\0"
            else w
            for w in WORD.findall(text)
        ]
    words = text.replace("\n", " \n").split(" ")
    words[0] = "\0" + words[0]
    return words


def spelled(word: str) -> str:
    """The characters a key of ``words_of`` stands for."""
    if word[0] == "\0":
        return word[1:]
    return word if word[0] in SPACES else " " + word


class WordEncoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers.  With ``ordinary``
    the strings of special tokens inside texts are ordinary text."""

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = ordinary
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = cuts_at_spaces(spec)
        self.known: dict[str, bytes] = {}
        self.lengths: dict[str, int] = {}
        if self.by_word:
            self.bytes_of = np.zeros(self.library.get_vocab_size(), np.int64)
            for token, i in spec["model"]["vocab"].items():
                self.bytes_of[i] = len(token)  # one character stands for one byte
            for token in spec.get("added_tokens", []):
                self.bytes_of[token["id"]] = len(token["content"].encode())

    def whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        encoded = self.library.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in encoded]

    def _ids(self, words: Sequence[str]) -> dict[str, bytes]:
        """Ids of words that start with white space, many words to a text."""
        groups: list[list[str]] = []
        size = AT_ONCE
        for word in words:
            if size >= AT_ONCE:
                groups.append([])
                size = 0
            groups[-1].append(word)
            size += len(word)
        texts = [[spelled(w) for w in group] for group in groups]
        found: dict[str, bytes] = {}
        for group, parts, ids in zip(
            groups, texts, self.whole(["".join(x) for x in texts]), strict=True
        ):
            ends = np.cumsum(self.bytes_of[ids])
            stops = np.cumsum([len(x.encode()) for x in parts])
            raw, begin = ids.tobytes(), 0
            for word, cut in zip(
                group, (4 + 4 * np.searchsorted(ends, stops)).tolist(), strict=True
            ):
                found[word] = raw[begin:cut]
                begin = cut
        return found

    def _new(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not met before.  A letter followed by a mark is a cut as well, so
        a word with marks behind it is two parts, which other words share."""
        known, parts = self.known, {}
        for word in words:
            stem = word.rstrip(".,;:!?")
            if stem != word and stem[-1:].isascii() and stem[-1:].isalpha():
                parts[word] = (stem, "\0" + word[len(stem) :])
        wanted = words.difference(parts).union(
            x for pair in parts.values() for x in pair if x not in known
        )
        alone = [w for w in wanted if w[0] == "\0"]
        found = self._ids([w for w in wanted if w[0] != "\0"])
        found.update(
            (w, ids.tobytes())
            for w, ids in zip(alone, self.whole([w[1:] for w in alone]), strict=True)
        )
        for word, (stem, tail) in parts.items():
            found[word] = (found.get(stem) or known[stem]) + (found.get(tail) or known[tail])
        return found

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if not self.by_word:
            return [ids.tobytes() for ids in self.whole(texts)]
        cut = [words_of(text) for text in texts]
        known = self.known
        new = self._new(set(chain.from_iterable(cut)).difference(known))
        room = KEPT_WORDS - len(known)
        known.update(new)
        ids = [b"".join(map(known.__getitem__, words)) for words in cut]
        for at, word in enumerate(new):
            if at >= room or len(word) > LONG_WORD:
                del known[word]
        return ids


    def counts(self, texts: Sequence[str]) -> list[int]:
        """Number of ids per text; only counts are kept, not ids."""
        if not self.by_word:
            return [len(ids) for ids in self.whole(texts)]
        cut = [words_of(text) for text in texts]
        lengths = self.lengths
        new = set(chain.from_iterable(cut)).difference(lengths)
        room = KEPT_WORDS - len(lengths)
        fresh = self._new(new)
        for word, ids in fresh.items():
            lengths[word] = len(ids) >> 2
        found = [sum(map(lengths.__getitem__, words)) for words in cut]
        for at, word in enumerate(fresh):
            if at >= room or len(word) > LONG_WORD:
                del lengths[word]
        return found


def cuts_at_spaces(spec: dict) -> bool:
    """Whether cutting before white space is safe for a file: a byte-level pre-tokenizer
    with its own pattern, no prefix space, no normaliser, and added tokens that neither
    hold white space nor take it from their sides."""
    before = spec.get("pre_tokenizer") or {}
    return bool(
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space", True)
        and not spec.get("normalizer")
        and spec["model"].get("type") == "BPE"
        and not any(
            t.get("lstrip")
            or t.get("rstrip")
            or t.get("single_word")
            or re.search(r"\s", t["content"])
            for t in spec.get("added_tokens", [])
        )
    )


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, ordinary: bool = False) -> WordEncoder:
    """One encoder per worker process, file and way to take special tokens."""
    if (path, ordinary) not in _ENCODERS:
        _ENCODERS[path, ordinary] = WordEncoder(path, ordinary)
    return _ENCODERS[path, ordinary]
