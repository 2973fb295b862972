"""How far a match of a pattern may reach in a text.

A pattern becomes a position automaton: one position per character class, and which may
follow which.  Read along a text it tells at every place whether a match that began before
may go on behind it.  Where none may, the place is a *cut*: no match lies across it, and the
texts on both sides can be searched apart with the same result.  The automaton may take
more than the pattern does (possessive and atomic groups are read as plain ones), never
less, so a cut is always one.  Patterns that look beyond their match (anchors, look-around,
back references) have no automaton.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache
from re import _constants as code
from re import _parser as parser

#: Character classes of one automaton at most, copies of counted repeats included.
MAX_POSITIONS = 2000
_PROPERTY = re.compile(r"\\([pP])\{(\w+)\}")
#: Where names of properties are kept while Python reads the pattern (private use area).
_HOLDER = 0xF0000
#: The ASCII classes of Java's regular expressions.
_CATEGORIES = {
    code.CATEGORY_DIGIT: "0123456789",
    code.CATEGORY_SPACE: " \t\n\x0b\f\r",
    code.CATEGORY_WORD: "0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
}
_NEGATED = {
    code.CATEGORY_NOT_DIGIT: code.CATEGORY_DIGIT,
    code.CATEGORY_NOT_SPACE: code.CATEGORY_SPACE,
    code.CATEGORY_NOT_WORD: code.CATEGORY_WORD,
}
Test = Callable[[str], bool]


class Unsupported(ValueError):
    """A pattern whose reach cannot be told."""


def _properties(regex: str) -> tuple[str, list[tuple[bool, str]]]:
    """The pattern with its Unicode properties replaced by placeholders."""
    found: list[tuple[bool, str]] = []

    def hold(match: re.Match) -> str:
        name = match[2].removeprefix("Is")
        if not re.fullmatch("[LMNPSZC][a-z]?", name):
            raise Unsupported(f"property {match[2]}")
        found.append((match[1] == "p", name))
        return chr(_HOLDER + len(found) - 1)

    return _PROPERTY.sub(hold, regex), found


def _item_test(kind, value, properties: list[tuple[bool, str]]) -> Test:
    """Test of one member of a character class."""
    if kind is code.LITERAL and _HOLDER <= value < _HOLDER + len(properties):
        wanted, name = properties[value - _HOLDER]
        return lambda c: unicodedata.category(c).startswith(name) == wanted
    if kind is code.LITERAL:
        return lambda c: ord(c) == value
    if kind is code.RANGE:
        return lambda c: value[0] <= ord(c) <= value[1]
    if kind is code.CATEGORY and value in _CATEGORIES:
        return lambda c: c in _CATEGORIES[value]
    if kind is code.CATEGORY and value in _NEGATED:
        return lambda c: c not in _CATEGORIES[_NEGATED[value]]
    raise Unsupported(str(kind))


def _class_test(kind, value, properties, flags: int) -> Test:
    """Test of one character class."""
    if kind is code.ANY:
        return (lambda c: True) if flags & re.DOTALL else (lambda c: c != "\n")
    if kind is code.NOT_LITERAL:
        inside = _item_test(code.LITERAL, value, properties)
        return lambda c: not inside(c)
    members = value if kind is code.IN else [(kind, value)]
    negated = bool(members) and members[0][0] is code.NEGATE
    tests = [_item_test(*m, properties) for m in members if m[0] is not code.NEGATE]
    if negated:
        return lambda c: not any(t(c) for t in tests)
    if flags & re.IGNORECASE:
        return lambda c: any(t(x) for t in tests for x in {c, c.lower()[:1], c.upper()[:1]})
    return lambda c: any(t(c) for t in tests)


class _Part:
    """Positions of a part of a pattern: which begin it, end it, and whether it can be empty."""

    __slots__ = ("first", "last", "empty")

    def __init__(self, first: int = 0, last: int = 0, empty: bool = True):
        self.first, self.last, self.empty = first, last, empty


class Automaton:
    """Positions of several patterns; sets of positions are bits of an integer."""

    def __init__(self, regexes: Sequence[str], separator: str):
        self.tests: list[Test] = []
        self.follow: list[int] = []
        self.start = 0
        for regex in regexes:
            held, properties = _properties(regex)
            try:
                tree = parser.parse(held)
            except (re.error, OverflowError) as error:
                raise Unsupported(str(error)) from error
            self.start |= self._sequence(tree, properties, tree.state.flags).first
        self.masks: dict[str, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        #: What may go on behind a separator, if anything reached over it.
        self.entry = self._next(self._ending(separator[-1])) if separator else 0

    # -- construction

    def _position(self, test: Test) -> _Part:
        if len(self.tests) >= MAX_POSITIONS:
            raise Unsupported("too many positions")
        bit = 1 << len(self.tests)
        self.tests.append(test)
        self.follow.append(0)
        return _Part(bit, bit, False)

    def _bits(self, positions: int):
        while positions:
            low = positions & -positions
            yield low.bit_length() - 1
            positions ^= low

    def _link(self, last: int, first: int) -> None:
        for at in self._bits(last):
            self.follow[at] |= first

    def _after(self, one: _Part, two: _Part) -> _Part:
        self._link(one.last, two.first)
        return _Part(
            one.first | (two.first if one.empty else 0),
            two.last | (one.last if two.empty else 0),
            one.empty and two.empty,
        )

    def _sequence(self, items, properties, flags: int) -> _Part:
        whole = _Part()
        for kind, value in items:
            whole = self._after(whole, self._node(kind, value, properties, flags))
        return whole

    def _node(self, kind, value, properties, flags: int) -> _Part:
        if kind is code.SUBPATTERN:
            _, added, removed, inside = value
            return self._sequence(inside, properties, (flags | added) & ~removed)
        if kind is code.ATOMIC_GROUP:
            return self._sequence(value, properties, flags)
        if kind is code.BRANCH:
            ways = [self._sequence(way, properties, flags) for way in value[1]]
            whole = _Part(empty=any(w.empty for w in ways))
            for way in ways:
                whole.first |= way.first
                whole.last |= way.last
            return whole
        if kind in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
            return self._repeat(*value, properties, flags)
        if kind in (code.LITERAL, code.NOT_LITERAL, code.IN, code.ANY):
            return self._position(_class_test(kind, value, properties, flags))
        raise Unsupported(str(kind))

    def _repeat(self, least: int, most: int, inside, properties, flags: int) -> _Part:
        whole = _Part()
        for _ in range(least):
            whole = self._after(whole, self._sequence(inside, properties, flags))
        if most is code.MAXREPEAT:
            loop = self._sequence(inside, properties, flags)
            self._link(loop.last, loop.first)
            return self._after(whole, _Part(loop.first, loop.last, True))
        for _ in range(most - least):
            more = self._sequence(inside, properties, flags)
            whole = self._after(whole, _Part(more.first, more.last, True))
        return whole

    # -- reading

    def _mask(self, char: str) -> int:
        mask = self.masks.get(char)
        if mask is None:
            mask = sum(1 << i for i, test in enumerate(self.tests) if test(char))
            self.masks[char] = mask
        return mask

    def _ending(self, char: str) -> int:
        return self._mask(char)

    def _next(self, taken: int) -> int:
        found = 0
        for at in self._bits(taken):
            found |= self.follow[at]
        return found

    def step(self, going: int, char: str) -> int:
        """What may go on behind ``char`` of what might go on before it."""
        key = (going, char)
        found = self.steps.get(key)
        if found is None:
            if len(self.steps) > 200_000:
                self.steps.clear()
            found = self.steps[key] = self._next(going & self._mask(char))
        return found

    def read(
        self, text: str, separator: str, kept: Sequence[tuple[int, int]] = ()
    ) -> tuple[int, int, int, bool, bool]:
        """(first, last, entered, carried, open) of a row's text.

        ``first`` and ``last`` are its outer cuts if nothing comes in over the border before
        it, ``entered`` the first one if anything may; -1 without any.  ``kept`` are intervals
        that are not cut.  ``carried`` says that what comes in may outlive the row and its
        separator, ``open`` that something of its own may.
        """
        first = last = entered = -1
        mine, came = 0, self.entry
        blocked = sorted(kept)
        at_block, until = 0, -1
        for at in range(len(text) + 1):
            while at_block < len(blocked) and blocked[at_block][0] < at:
                until = max(until, blocked[at_block][1])
                at_block += 1
            if not mine and at >= until:
                last = at
                if first < 0:
                    first = at
                if entered < 0 and not came:
                    entered = at
            if at < len(text):
                char = text[at]
                mine = self.step(mine | self.start, char)
                if came:
                    came = self.step(came, char)
        for char in separator:
            mine = self.step(mine | self.start, char)
            if came:
                came = self.step(came, char)
        return first, last, entered, bool(came), bool(mine)


@cache
def automaton(regexes: tuple[str, ...], separator: str) -> Automaton:
    """One automaton per worker process."""
    return Automaton(regexes, separator)


def supported(regexes: Sequence[str], separator: str) -> bool:
    """Whether the reach of all patterns can be told."""
    try:
        automaton(tuple(regexes), separator)
    except Unsupported:
        return False
    return True
