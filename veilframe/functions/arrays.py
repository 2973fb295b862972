"""Array building blocks shared by the Sql-level functions.

Everything here is a Sql -> Sql helper made of higher-order functions, so the
operators built on it stay row-local: no shuffle, no Python worker, and the same
expression runs in batch and in a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from .sql import Sql, fn, lit, sql, struct, when

#: Elements folded per inner loop; keeps array appends short (see ``fold_emit``).
PIECE = 64


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once and hand it to ``body``.

    Lambda bodies re-evaluate any outer expression for each element; binding it first
    keeps a regular expression or a digest from running once per span.
    """
    return fn.element_at(fn.transform(fn.array(value), body), 1)


def empty(ddl: str) -> Sql:
    return fn.array().cast(f"array<{ddl}>")


def indices(count: Sql, step: int = 1, first: int = 0) -> Sql:
    """``first, first+step, ... < count`` as an array; empty when there are none."""
    return when(
        count > first, fn.sequence(lit(first), count - 1, lit(step))
    ).otherwise(empty("int"))


def part(items: Sql, first: Sql | int, count: Sql | int) -> Sql:
    """``count`` elements from position ``first`` (0-based), by index.

    ``slice`` copies its whole input on every call, which makes cutting a long array into
    many parts quadratic; positions are read in constant time.
    """
    first, count = sql(first), sql(count)
    return fn.transform(
        when(count > 0, fn.sequence(first, first + count - 1)).otherwise(empty("int")),
        lambda k: items[k],
    )


def pieces_of(items: Sql) -> Sql:
    """An array in parts of ``PIECE``."""
    return let(
        items,
        lambda bound: when(
            fn.size(bound) <= PIECE,
            fn.filter(fn.array(bound), lambda whole: fn.size(whole) > 0),
        ).otherwise(
            fn.transform(
                indices(fn.size(bound), PIECE),
                lambda i: part(bound, i, fn.least(fn.size(bound) - i, PIECE)),
            )
        ),
    )


def fold_piece(
    items: Sql,
    zero: Sql,
    step: Callable[[Sql, Sql], Sql],
    out_type: str,
) -> Sql:
    """Fold of a short array: ``struct(state, out)``; see ``fold_emit`` for ``step``."""
    return fn.aggregate(
        items,
        struct(state=zero, out=empty(out_type)),
        lambda acc, item: let(
            step(acc["state"], item),
            lambda r: struct(
                state=r["state"],
                out=when(fn.size(r["emit"]) > 0, fn.concat(acc["out"], r["emit"])).otherwise(
                    acc["out"]
                ),
            ),
        ),
    )


def fold_emit(
    items: Sql,
    zero: Sql,
    step: Callable[[Sql, Sql], Sql],
    out_type: str,
) -> Sql:
    """Ordered fold over ``items`` that also emits rows.

    ``step(state, item)`` returns ``struct(state, emit)`` where ``emit`` is an array of
    ``out_type`` (usually zero or one element).  The result is all emitted elements in
    order.  Appending to one growing array would be quadratic in the array length, so
    items are folded in pieces of ``PIECE`` and the pieces are flattened once.
    """
    def fold_pieces(bound: Sql) -> Sql:
        return fn.aggregate(
            pieces_of(bound),
            struct(state=zero, out=empty(f"array<{out_type}>")),
            lambda acc, piece: let(
                fold_piece(piece, acc["state"], step, out_type),
                lambda r: struct(
                    state=r["state"], out=fn.concat(acc["out"], fn.array(r["out"]))
                ),
            ),
            lambda acc: fn.flatten(acc["out"]),
        )

    return let(items, fold_pieces)


def fold_emit_long(
    items: Sql,
    zero: Sql,
    step: Callable[[Sql, Sql], Sql],
    out_type: str,
) -> Sql:
    """``fold_emit`` for rows of tens of thousands of items: pieces are folded in groups of
    ``PIECE``, so that what a piece emits is copied twice and not once per later piece."""

    def fold_group(group: Sql, state: Sql) -> Sql:
        return fn.aggregate(
            group,
            struct(state=state, out=empty(f"array<{out_type}>")),
            lambda acc, piece: let(
                fold_piece(piece, acc["state"], step, out_type),
                lambda r: struct(
                    state=r["state"], out=fn.concat(acc["out"], fn.array(r["out"]))
                ),
            ),
            lambda acc: struct(state=acc["state"], out=fn.flatten(acc["out"])),
        )

    def fold_groups(bound: Sql) -> Sql:
        return fn.aggregate(
            pieces_of(pieces_of(bound)),
            struct(state=zero, out=empty(f"array<{out_type}>")),
            lambda acc, group: let(
                fold_group(group, acc["state"]),
                lambda r: struct(
                    state=r["state"], out=fn.concat(acc["out"], fn.array(r["out"]))
                ),
            ),
            lambda acc: fn.flatten(acc["out"]),
        )

    return let(items, fold_groups)


def fold_some(
    items: Sql,
    zero: Sql,
    step: Callable[[Sql, Sql], tuple[Sql, Sql, Sql]],
    out_type: str,
) -> Sql:
    """``fold_emit_long`` of at most one row per item: ``step(state, item)`` returns the next
    state, whether the item emits, and what.

    ``let`` copies its result with all that is in it; here nothing is bound per item.
    """

    def next_of(acc: Sql, item: Sql) -> Sql:
        state, emits, row = step(acc["state"], item)
        return struct(
            state=state,
            out=when(emits, fn.concat(acc["out"], fn.array(row))).otherwise(acc["out"]),
        )

    def folded(piece: Sql, state: Sql) -> Sql:
        return fn.aggregate(piece, struct(state=state, out=empty(out_type)), next_of)

    def joined(parts: Sql, state: Sql, fold: Callable[[Sql, Sql], Sql]) -> Sql:
        return fn.aggregate(
            parts,
            struct(state=state, out=empty(f"array<{out_type}>")),
            lambda acc, part_: let(
                fold(part_, acc["state"]),
                lambda r: struct(
                    state=r["state"], out=fn.concat(acc["out"], fn.array(r["out"]))
                ),
            ),
            lambda acc: struct(state=acc["state"], out=fn.flatten(acc["out"])),
        )

    def whole(bound: Sql) -> Sql:
        groups = pieces_of(pieces_of(bound))
        long = joined(groups, zero, lambda group, state: joined(group, state, folded))["out"]
        return when(fn.size(bound) <= PIECE, folded(bound, zero)["out"]).otherwise(long)

    return let(items, whole)


def running_starts(lengths: Sql) -> Sql:
    """Exclusive prefix sum of an int array: where each element begins."""

    def add(total: Sql, size: Sql) -> Sql:
        return total + size

    def within(piece: Sql, first: Sql) -> Sql:
        summed = fn.aggregate(
            piece,
            fn.array(first),
            lambda acc, size: fn.concat(acc, fn.array(fn.element_at(acc, -1) + size)),
        )
        return fn.slice(summed, 1, fn.size(piece))

    def starts_of(v: Sql) -> Sql:
        totals = fn.transform(v, lambda p: fn.aggregate(p, lit(0), add))
        bases = fold_emit(
            totals,
            lit(0),
            lambda at, size: struct(state=at + size, emit=fn.array(at)),
            "int",
        )

        return fn.flatten(fn.zip_with(v, bases, within))

    def starts(bound: Sql) -> Sql:
        return when(fn.size(bound) <= PIECE, within(bound, lit(0))).otherwise(
            let(pieces_of(bound), starts_of)
        )

    return let(lengths, starts)


def chars(text: Sql) -> Sql:
    """Code points of a text, one string each."""
    return fn.regexp_extract_all(text, lit("(?s)."), lit(0))


def banded(
    items: Sql, start: Callable[[Sql], Sql], end: Callable[[Sql], Sql]
) -> Sql:
    """Intervals in pieces with their bounds, so that ``touching`` looks at few of them."""
    return fn.transform(
        pieces_of(items),
        lambda p: struct(
            low=fn.array_min(fn.transform(p, start)),
            high=fn.array_max(fn.transform(p, end)),
            items=p,
        ),
    )


def touching(
    bands: Sql,
    low: Sql,
    high: Sql,
    start: Callable[[Sql], Sql],
    end: Callable[[Sql], Sql],
) -> Sql:
    """Items of ``banded`` that overlap ``[low, high)``, in order.

    Comparing every interval with every other is quadratic in a long row; bands that lie
    elsewhere are skipped whole.
    """
    near = fn.filter(bands, lambda b: (b["low"] < high) & (b["high"] > low))
    return fn.filter(
        fn.flatten(fn.transform(near, lambda b: b["items"])),
        lambda x: (start(x) < high) & (end(x) > low),
    )
