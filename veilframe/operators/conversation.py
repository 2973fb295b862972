"""Conversations: detect across the rows of a group, give each row its own result.

A group is one document: its rows, joined by a separator, so that an entity may start in
one row and end in any later one.  Whether that can happen is a matter of the patterns, not
of the data.  If no pattern can match the separator, no entity crosses it, and every row is
detected where it lies, without a shuffle.

Otherwise the patterns that can are read as automata (``functions.reach``): row by row, in
place, they tell where a match may lie across the row's ends.  Only the ends that a match can
reach meet those of the neighbouring rows; the rest of a row is searched where it lies.  What
meets is as long as the reach of the matches, whatever the size of the group.

Patterns that look beyond their match, block lists, grouped synthesis and orders that are no
integers need the whole group as one text; a group that is too large for a cell then fails
the job rather than lose entities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import reach
from ..functions.arrays import banded, empty, running_starts, touching
from ..functions.spans import SPAN, Pattern, splice, with_new_offsets
from ..functions.sql import Sql, col, fn, lit, struct, when
from ..policy import Policy
from ..session import settle
from . import detect as detection
from .ordered import prefix_max, prefix_sum
from .redact import new_texts, patterns_for


def with_line_offsets(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str = "text",
    separator: str = "\n",
    **cut: int,
) -> DataFrame:
    """``line_start``/``line_end`` of each row in the joined text of its group."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    placed = prefix_sum(
        df, keys, order, (size + len(separator)).cast("bigint"), "line_start", **cut
    )
    return placed.withColumn("line_end", F.col("line_start") + size)


# What an expression may hold and still be sure not to match a line end or to look past one.
_SAFE_ESCAPE = re.compile(r"\\(?:[wdStQE]|[^A-Za-z0-9]|p\{(?:L|Lu|Ll|Lt|N|Nd)\})")
_SAFE_GROUP = re.compile(r"\(\?(?:i?:|>|i\))")


def stays_in_line(regex: str, separator: str = "\n") -> bool:
    """Whether ``regex`` surely matches no separator and does not look past one.

    Decided from the expression alone, on the safe side: anchors, look-around, negated
    classes that do not name the line end, and escapes that may stand for white space say
    no.
    """
    if "\n" not in separator or "\n" in regex.replace("[^\n", "[^"):
        return False
    rest = _SAFE_ESCAPE.sub("x", regex.replace(r"\n", "\n"))
    # a negated class is safe if the line end is among what it excludes
    rest = re.sub(r"\[\^[^\]]*\n[^\]]*\]", "x", rest)
    rest = _SAFE_GROUP.sub("(", rest)
    return not re.search(r"[\\^$\n]|\(\?", rest)


def needs_whole_group(
    patterns: Sequence[Pattern], policy: Policy, separator: str = "\n"
) -> bool:
    """Whether an entity, a block or a decision may depend on more than one row."""
    others = [p for p in patterns if not (p.in_line and "\n" in separator)]
    regexes = [x for p in others for x in (p.body, p.prefix or "")]
    regexes += [x for rules in policy.block.values() for x in rules]
    return (
        any(p.accept is not None for p in others)
        or not all(stays_in_line(x, separator) for x in regexes)
        or model.GROUPING_SYNTHESIS in (policy.default, *policy.config.values())
    )


def whole_groups(
    df: DataFrame, keys: Sequence[str], order: str, text: str, separator: str = "\n"
) -> DataFrame:
    """One row per group: its rows in order, where each begins, and their joined text."""
    row = F.struct(F.col(order).alias("ord"), F.col(text).alias("text"))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    texts = fn.transform(col("_rows"), lambda r: fn.coalesce(r["text"], ""))
    lengths = fn.transform(texts, lambda t: fn.length(t) + len(separator))
    return grouped.withColumns(
        {
            "_starts": running_starts(lengths).column(),
            "_text": fn.array_join(texts, separator).column(),
        }
    )


def rows_of_groups(found: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Back to rows, each with the spans that touch it.

    Needs ``_spans`` (resolved, on the group's text) and ``_news``; a span crossing a border
    is clipped to the row, with the whole replacement on every row it touches.
    """
    pairs = fn.zip_with(col("_spans"), col("_news"), lambda s, n: struct(s=s, n=n))
    placed = fn.zip_with(col("_rows"), col("_starts"), lambda r, a: struct(r=r, at=a))

    starts, ends = (lambda p: p["s"]["start"]), (lambda p: p["s"]["end"])

    def hits(line: Sql) -> Sql:
        begin = line["at"]
        end = begin + fn.length(fn.coalesce(line["r"]["text"], ""))
        return fn.transform(
            touching(col("_bands"), begin, end, starts, ends),
            lambda p: struct(
                start=fn.greatest(p["s"]["start"] - begin, 0),
                end=fn.least(p["s"]["end"], end) - begin,
                label=p["s"]["label"],
                text=p["s"]["text"],
                score=p["s"]["score"],
                language=p["s"]["language"],
                path=p["s"]["path"],
                new_text=p["n"],
            ),
        )

    found = found.withColumns({"_pairs": pairs.column(), "_placed": placed.column()})
    bands = banded(col("_pairs"), starts, ends)
    lines = found.withColumn("_bands", bands.column()).select(
        *keys,
        F.explode(
            fn.transform(
                col("_placed"),
                lambda v: struct(
                    ord=v["r"]["ord"], text=v["r"]["text"], hits=hits(v)
                ),
            ).column()
        ).alias("_line"),
    )
    return lines.select(
        *keys,
        F.col("_line.ord").alias(order),
        F.col("_line.text").alias("original_text"),
        F.col("_line.hits").alias("_hits"),
    )


def crossing(
    patterns: Sequence[Pattern], policy: Policy, separator: str = "\n"
) -> list[Pattern] | None:
    """The patterns whose matches may cross a row border, if their reach can be told and
    nothing else looks at more than one row; else None."""
    if policy.block or model.GROUPING_SYNTHESIS in (policy.default, *policy.config.values()):
        return None
    found = [
        p
        for p in patterns
        if not (p.in_line and "\n" in separator)
        and (p.accept is not None or not all(stays_in_line(x, separator) for x in (p.body, p.prefix or "")))
    ]
    if any(p.accept is not None or p.prefix for p in found):
        return None
    return found if reach.supported([p.body for p in found], separator) else None


_CUTS = "first int, last int, entered int, carried boolean, open boolean"


def cuts_of(text: Column, kept: Column, regexes: Sequence[str], separator: str) -> Column:
    """Struct of a row's cuts: the first and last if nothing comes in over the border before
    it, the first if something may (-1: none), whether what comes in outlives the row, and
    whether something of its own does.  ``kept`` are intervals that are not cut."""
    bodies = tuple(regexes)

    @F.pandas_udf(_CUTS)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        machine = reach.automaton(bodies, separator)
        for texts, intervals in batches:
            out = []
            for value, spans in zip(texts, intervals, strict=True):
                value = value or ""
                pairs = [] if spans is None else [(s["start"], s["end"]) for s in spans]
                out.append(machine.read(value, separator, pairs))
            yield pd.DataFrame(out, columns=["first", "last", "entered", "carried", "open"])

    return read(text, kept)


#: Parts of a row: where they begin, their text, the spans inside.
_PIECE = f"struct<begin:int,text:string,spans:array<{SPAN}>>"


def _moved(spans: Sql, by: Sql) -> Sql:
    return fn.transform(
        spans,
        lambda s: struct(
            start=s["start"] + by,
            end=s["end"] + by,
            label=s["label"],
            text=s["text"],
            score=s["score"],
            language=s["language"],
            path=s["path"],
        ),
    )


def _piece(begin: Sql, end: Sql) -> Sql:
    """Part of a row, with the row's spans that lie inside: none is ever cut."""
    inside = fn.filter(col("_own"), lambda s: (s["start"] >= begin) & (s["end"] <= end))
    return struct(
        begin=begin, text=fn.substring(col("_line"), begin + 1, end - begin), spans=_moved(inside, -begin)
    )


def row_pieces(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    own: Sequence[Pattern],
    across: Sequence[Pattern],
    separator: str = "\n",
) -> DataFrame:
    """The rows in pieces, where they lie: (keys, order, _text, _own, _head, _middle, _tail,
    _closed).

    ``_own`` are the spans of ``own``, overlaps and all.  A match of ``across`` that comes in
    over the border before a row stays in ``_head``, one that goes out over the border behind
    it in ``_tail``.  A row without a cut between is a head only.  ``_closed`` says that nothing goes
    out over the border behind the row.
    """
    rows = detection.with_spans(
        df.select(
            *keys, order, F.col(text).alias("_text"), F.coalesce(F.col(text), F.lit("")).alias("_line")
        ),
        own,
        "_line",
        "_own",
        overlaps=True,
    )
    bounds = F.transform("_own", lambda s: F.struct(s["start"], s["end"]))
    read = cuts_of(F.col("_line"), bounds, [p.body for p in across], separator)
    # as a generated row it is not copied into the lambdas that read it, where no Python
    # function may stand
    cut = rows.select("*", F.explode(F.array(read)).alias("_cuts"))
    size, cuts = fn.length(col("_line")), col("_cuts")
    through = cuts["carried"] | (cuts["entered"] < 0)
    begin = cuts["entered"]
    end = when(cuts["open"], cuts["last"]).otherwise(size)
    nothing = lit(None).cast(_PIECE)
    return cut.select(
        *keys,
        order,
        "_text",
        when(through, _piece(lit(0), size)).otherwise(_piece(lit(0), begin)).column().alias("_head"),
        when(through, nothing).otherwise(_piece(begin, end)).column().alias("_middle"),
        when(through | ~cuts["open"], nothing).otherwise(_piece(end, size)).column().alias("_tail"),
        (~cuts["open"] & ~cuts["carried"]).column().alias("_closed"),
    )


def joined_pieces(units: DataFrame, separator: str) -> DataFrame:
    """``units`` (``_rows``: pieces in order) plus their text, where each piece begins, and the
    spans brought along."""
    lengths = fn.transform(col("_rows"), lambda r: fn.length(r["text"]) + len(separator))
    texts = fn.transform(col("_rows"), lambda r: r["text"])
    brought = fn.zip_with(col("_rows"), col("_starts"), lambda r, at: _moved(r["spans"], at))
    return units.withColumns(
        {
            "_starts": running_starts(lengths).column(),
            "_joined": fn.array_join(texts, separator).column(),
        }
    ).withColumn("_extra", fn.flatten(brought).column())


def _hits(spans: Sql, news: Sql, by: Sql) -> Sql:
    """Spans with their replacements, moved."""
    return fn.zip_with(
        fn.coalesce(_moved(spans, by), empty(SPAN)),
        fn.coalesce(news, empty("string")),
        lambda s, n: struct(
            start=s["start"],
            end=s["end"],
            label=s["label"],
            text=s["text"],
            score=s["score"],
            language=s["language"],
            path=s["path"],
            new_text=n,
        ),
    )


_HITS = SPAN.replace("path:string>", "path:string,new_text:string>")


def searched(
    units: DataFrame,
    keys: Sequence[str],
    policy: Policy,
    across: Sequence[Pattern],
    separator: str,
    document: Sql,
) -> DataFrame:
    """The pieces of ``units`` (keys, ``_rows``) with the spans that touch them: (keys, _at,
    original_text, _hits), offsets within the piece."""
    found = detection.with_spans(
        joined_pieces(units, separator), across, "_joined", "_spans", extra="_extra"
    )
    found = found.withColumn("_spans", policy.keep(col("_spans")).column()).withColumn(
        "_news", new_texts(policy, col("_spans"), document).column()
    )
    return rows_of_groups(found, keys, "_at")


def _across_rows(
    df: DataFrame,
    policy: Policy,
    keys: list[str],
    order: str,
    text: str,
    separator: str,
    patterns: Sequence[Pattern],
    across: Sequence[Pattern],
    document: Sql,
) -> DataFrame:
    """(keys, order, original_text, _hits): matches that cross borders are found in the ends
    of the rows that they may reach, everything else where it lies."""
    own = [p for p in patterns if p not in across]
    pieces = row_pieces(df, keys, order, text, own, across, separator)

    # what a row's head is joined to begins in the last row before it that has a cut, or
    # behind the last closed border
    anchor = F.struct(F.col(order).alias("at"), F.col("_closed").alias("closed"))
    # the ends are read once per block level: kept, as they are short and the texts are not
    short = settle(
        pieces.select(*keys, order, "_head", "_tail", "_closed", F.col("_middle").isNotNull().alias("_cut"))
    )
    ends = prefix_max(
        short,
        keys,
        order,
        {"_unit": F.when(F.col("_cut") | F.col("_closed"), anchor)},
    )
    named = F.array(
        F.struct(F.col("_unit").alias("unit"), F.col("_head").alias("piece")),
        F.struct(
            F.struct(F.col(order).alias("at"), F.lit(False).alias("closed")).alias("unit"),
            F.col("_tail").alias("piece"),
        ),
    )
    parts = ends.select(*keys, order, F.explode(named).alias("_p")).where("_p.piece IS NOT NULL")
    piece = F.struct(
        F.struct(F.col(order).alias("order"), F.col("_p.piece.begin").alias("begin")).alias("ord"),
        F.col("_p.piece.text").alias("text"),
        F.col("_p.piece.spans").alias("spans"),
    )
    units = parts.groupBy(*keys, F.col("_p.unit").alias("_unit")).agg(
        F.array_sort(F.collect_list(piece)).alias("_rows")
    )
    lines = searched(units, [*keys, "_unit"], policy, across, separator, document)
    begin = col("_at.begin")
    moved = _hits(col("_hits"), fn.transform(col("_hits"), lambda h: h["new_text"]), begin)
    by_row = (
        lines.where(F.size("_hits") > 0)
        .groupBy(*keys, F.col("_at.order").alias(order))
        .agg(F.collect_list(moved.column()).alias("_more"))
    )

    middles = detection.with_spans(
        pieces.select(*keys, order, "_text", "_middle", F.col("_middle.text").alias("_line"), F.col("_middle.spans").alias("_extra")),
        across,
        "_line",
        "_spans",
        extra="_extra",
    )
    middles = middles.withColumn("_spans", policy.keep(col("_spans")).column()).withColumn(
        "_news", new_texts(policy, col("_spans"), document).column()
    )
    inner = _hits(col("_spans"), col("_news"), fn.coalesce(col("_middle.begin"), lit(0)))
    rows = middles.select(*keys, order, "_text", inner.column().alias("_inner"))
    same = [rows[k].eqNullSafe(by_row[k]) for k in [*keys, order]]
    every = fn.concat(col("_inner"), fn.flatten(fn.coalesce(col("_more"), empty(f"array<{_HITS}>"))))
    return rows.join(by_row, same, "left").select(
        *[rows[c] for c in [*keys, order]],
        F.col("_text").alias("original_text"),
        fn.array_sort(every).column().alias("_hits"),
    )


def redact_rows(
    df: DataFrame,
    policy: Policy,
    keys: Sequence[str],
    order: str,
    text: str = "text",
    separator: str = "\n",
    dictionaries: Sequence[Pattern] = (),
) -> DataFrame:
    """Per-row results of a redaction that saw each group as one text.

    No shuffle if no pattern can cross a row border; otherwise the ends of rows that a match
    may reach meet by group, or whole groups where the reach cannot be told.  ``usage`` is -1:
    words are counted per request, and a row is not one.  Offsets always index the row and
    its redacted text.
    """
    policy.validate()
    keys = list(keys)
    patterns = patterns_for(policy, dictionaries)
    document = fn.concat_ws("|", *[col(k).cast("string") for k in keys])
    whole = needs_whole_group(patterns, policy, separator)
    if whole and df.schema[order].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        across = crossing(patterns, policy, separator)
        if across is not None:
            return finish_rows(
                _across_rows(df, policy, keys, order, text, separator, patterns, across, document)
            )
    if whole:
        texts = whole_groups(df, keys, order, text, separator)
    else:
        texts = df.select(*keys, order, F.col(text).alias("_text"))
    found = detection.with_spans(texts, patterns, "_text", "_spans", policy.block)
    found = found.withColumn("_spans", policy.keep(col("_spans")).column()).withColumn(
        "_news", new_texts(policy, col("_spans"), document).column()
    )
    if whole:
        return finish_rows(rows_of_groups(found, keys, order))
    return finish_rows(
        found.select(
            *keys,
            order,
            F.col("_text").alias("original_text"),
            _hits(col("_spans"), col("_news"), lit(0)).column().alias("_hits"),
        )
    )


def finish_rows(lines: DataFrame) -> DataFrame:
    news = fn.transform(col("_hits"), lambda h: h["new_text"])
    return lines.withColumn("_news", news.column()).select(
        *[c for c in lines.columns if c != "_hits"],
        splice(col("original_text"), col("_hits"), col("_news"))
        .column()
        .alias("redacted_text"),
        F.lit(-1).alias("usage"),
        with_new_offsets(col("_hits"), col("_news")).column().alias("spans"),
    )


def length_difference(spans: Sql) -> Sql:
    """How much longer the redacted row is than the original."""
    return fn.aggregate(
        spans,
        lit(0),
        lambda acc, s: acc + fn.length(s["new_text"]) - (s["end"] - s["start"]),
    )


def rejoin(
    rows: DataFrame, keys: Sequence[str], order: str, separator: str = "\n"
) -> DataFrame:
    """Redacted rows joined again in order: one text per group."""
    row = F.struct(F.col(order), F.col("redacted_text"))
    return (
        rows.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        .select(*keys, F.array_join(F.col("_rows.redacted_text"), separator).alias("redacted_text"))
    )


def items(
    df: DataFrame, key: str, items_path: str, text_path: str, **fields: str
) -> DataFrame:
    """Conversation documents -> (key, turn, text, ...), in the order of the items."""
    exploded = df.select(key, F.posexplode(F.expr(items_path)).alias("turn", "_item"))
    return exploded.select(
        key,
        "turn",
        F.expr(f"_item.{text_path}").alias("text"),
        *[F.expr(f"_item.{path}").alias(name) for name, path in fields.items()],
    )


def joined_context(
    df: DataFrame, keys: Sequence[str], order: str, text: str = "text", separator: str = "\n"
) -> DataFrame:
    """The text a detector sees, one row per group."""
    return whole_groups(df, keys, order, text, separator).select(*keys, F.col("_text").alias("text"))


__all__ = [
    "finish_rows",
    "items",
    "joined_context",
    "length_difference",
    "needs_whole_group",
    "redact_rows",
    "rejoin",
    "rows_of_groups",
    "stays_in_line",
    "whole_groups",
    "with_line_offsets",
]
