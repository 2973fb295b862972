"""XML and HTML: redact text nodes and attribute values, leave the markup verbatim.

A document is cut into segments: markup, text, attribute values.  Visible text is joined
for detection (inline tags join, block tags separate), so an entity that straddles inline
tags is found; its spans are mapped back to the segments they touch, the replacement goes
to the first of them and the rest of the entity is removed from the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import (
    banded,
    empty,
    fold_emit,
    fold_some,
    indices,
    let,
    part,
    touching,
)
from ..functions.spans import MARK, STANDIN, Pattern, mark_safe, splice
from ..functions.sql import Sql, col, fn, lit, struct, when
from ..policy import Policy
from . import detect as detection
from .redact import new_texts, patterns_for

# HTML elements whose tags do not end a run of text.
INLINE = """
a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp
small span strike strong sub sup time tt u var wbr
""".split()

_HIDDEN_HTML = r"(?is:<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!.*?>|<\?.*?\?>)"
_HIDDEN_XML = r"(?s:<!--.*?-->|<!\[CDATA\[|\]\]>|<!.*?>|<\?.*?\?>)"
# possessive: the matcher loops over the rounds of the group instead of recursing
_TAG = r"(?s:</?[A-Za-z_:](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>)"
_VALUE = r"=[ \t\r\n]*(?:\"[^\"]+\"|'[^']+')"

SEGMENT = "struct<kind:string,text:string>"


def _pieces(text: Sql, regex: str) -> Sql:
    marked = fn.regexp_replace(text, f"(?:{regex})", f"{MARK}$0{MARK}")
    return fn.split(marked, MARK, -1)


# HTML elements without content, hence without a closing tag.
VOID = "area base br col embed hr img input link meta param source track wbr".split()


def tag_name(tag: Sql) -> Sql:
    return fn.regexp_extract(tag, r"^</?([A-Za-z_:][^ \t\r\n/>]*)", 1)


def _tag_segments(tag: Sql) -> Sql:
    """A tag cut at its quoted attribute values (namespace declarations are markup)."""

    def cut_value(piece: Sql) -> Sql:
        opening = fn.regexp_extract(piece, "^(=[ \\t\\r\\n]*[\"'])", 1)
        inside = fn.substring(
            piece, fn.length(opening) + 1, fn.length(piece) - fn.length(opening) - 1
        )
        return fn.array(
            struct(kind="markup", text=opening),
            struct(kind="attribute", text=inside),
            struct(kind="markup", text=fn.right(piece, 1)),
        )

    def cut_values(pieces: Sql) -> Sql:
        def declares(i: Sql) -> Sql:
            return pieces[i - 1].rlike(r"[ \t\r\n]xmlns(?::[A-Za-z0-9_.-]+)?[ \t\r\n]*\z")

        return fn.flatten(
            fn.transform(
                pieces,
                lambda p, i: when((i % 2 == 0) | (p == ""), fn.array(plain(p)))
                .when(declares(i), fn.array(plain(p)))
                .otherwise(cut_value(p)),
            )
        )

    def plain(piece: Sql) -> Sql:
        return struct(kind="markup", text=piece)

    return let(_pieces(tag, _VALUE), cut_values)


def segments(text: Sql, html: bool = True) -> Sql:
    """Segments of a document in order; their texts concatenate to the document."""
    regex = f"{_HIDDEN_HTML if html else _HIDDEN_XML}|{_TAG}"

    def segment(p: Sql, i: Sql) -> Sql:
        is_tag = p.rlike(r"^</?[A-Za-z_:]")
        hidden = p.rlike(r"(?i)^<(?:script|style)\b") if html else lit(False)
        return (
            when(i % 2 == 0, fn.array(struct(kind="text", text=p)))
            .when(is_tag & ~hidden & fn.contains(p, "="), _tag_segments(p))
            .when(
                is_tag & ~hidden & fn.lower(tag_name(p)).isin(INLINE if html else []),
                fn.array(struct(kind="inline", text=p)),
            )
            .otherwise(fn.array(struct(kind="markup", text=p)))
        )

    listed = fn.flatten(fn.transform(_pieces(mark_safe(text), regex), segment))
    return fn.filter(listed, lambda s: fn.length(s["text"]) > 0)


def _is_value(kind: Sql) -> Sql:
    return kind.isin(["text", "attribute"])


def _inline_opening(s: Sql) -> Sql:
    """Attributes split an inline tag into several segments; its name decides."""
    return s["text"].rlike("(?i)^</?(?:" + "|".join(INLINE) + r")(?:[ \t\r\n/>]|$)")


def reading(parts: Sql, html: bool = True) -> Sql:
    """Where each value segment stands in the joined reading text: ``(seg, at, text)``.

    Attribute values come after the whole visible text, one per line, so that they
    neither join nor interrupt it.
    """
    kind = "struct<seg:int,at:int,text:string>"
    numbered = fn.transform(parts, lambda p, i: struct(seg=i, kind=p["kind"], text=p["text"]))

    def step(state: Sql, p: Sql) -> tuple[Sql, Sql, Sql]:
        # state: position, whether block markup was seen since the last text, and whether an
        # inline tag is open that attributes have cut
        at = state["at"] + when(state["broken"] & (state["at"] > 0), 1).otherwise(0)
        opens = _inline_opening(p) if html else lit(False)
        kept = p["kind"].isin(["inline", "attribute"])
        inside = ~opens & state["closing"] & ~fn.startswith(p["text"], "<")
        text = p["kind"] == "text"
        after = struct(
            at=when(text, at + fn.length(p["text"])).otherwise(state["at"]),
            broken=when(text, False)
            .when(kept | opens | inside, state["broken"])
            .otherwise(True),
            closing=when(text, False)
            .when(kept, state["closing"])
            .when(opens, True)
            .otherwise(inside),
        )
        return after, text, struct(seg=p["seg"], at=at, text=p["text"])

    visible = fold_some(numbered, struct(at=0, broken=False, closing=False), step, kind)

    def attributes(v: Sql) -> Sql:
        last = fn.element_at(v["visible"], -1)
        end = fn.coalesce(last["at"] + fn.length(last["text"]), 0)

        def line(at: Sql, p: Sql) -> Sql:
            return struct(
                state=at + 1 + fn.length(p["text"]),
                emit=fn.array(struct(seg=p["seg"], at=at + 1, text=p["text"])),
            )

        own = fn.filter(v["parts"], lambda p: p["kind"] == "attribute")
        return fn.concat(v["visible"], fold_emit(own, end, line, kind))

    return when(
        fn.size(parts) > 0,
        let(
            struct(
                parts=numbered,
                visible=when(fn.size(parts) > 0, visible).otherwise(empty(kind)),
            ),
            lambda v: when(fn.size(v["visible"]) > 0, attributes(v)).otherwise(
                _attributes_only(v["parts"], kind)
            ),
        ),
    ).otherwise(empty(kind))


def _attributes_only(parts: Sql, kind: str) -> Sql:
    own = fn.filter(parts, lambda p: p["kind"] == "attribute")
    return fold_emit(
        own,
        lit(-1),
        lambda at, p: struct(
            state=at + 1 + fn.length(p["text"]),
            emit=fn.array(struct(seg=p["seg"], at=at + 1, text=p["text"])),
        ),
        kind,
    )


def reading_text(places: Sql) -> Sql:
    """Reading text: values at their places, newlines in between."""
    return fn.array_join(
        fn.transform(
            places,
            lambda p, i: fn.concat(
                when(
                    i > 0,
                    fn.repeat(
                        "\n",
                        p["at"] - places[i - 1]["at"] - fn.length(places[i - 1]["text"]),
                    ),
                ).otherwise(""),
                p["text"],
            ),
        ),
        "",
    )


_COUNTS = "array<struct<name:string,n:int>>"


def paths(parts: Sql, html: bool = True) -> Sql:
    """1-based path of every segment, e.g. ``/html[1]/body[1]/p[2]`` (+ ``/@name``).

    Every open element counts its children by name; the counts go when it closes, so a step
    costs the depth and the number of names, not the elements seen before.
    """

    def move(p: Sql) -> Sql:
        """What a segment does to the open elements."""
        text = p["text"]
        name = fn.lower(tag_name(text)) if html else tag_name(text)
        ends_empty = text.rlike(r"/>\z")
        void = ends_empty | name.isin(VOID) if html else ends_empty
        does = (
            when(p["kind"] == "attribute", "value")
            .when((p["kind"] == "text") | fn.startswith(text, "="), "none")
            .when(fn.startswith(text, "</"), "close")
            .when(text.rlike("^<[A-Za-z_:]"), when(void, "empty").otherwise("open"))
            .when(ends_empty, "close")
            .otherwise("name")
        )
        return let(
            does,
            lambda d: struct(
                does=d,
                name=when(d.isin(["empty", "open"]), name),
                attribute=when(d.isin(["empty", "open", "name"]), _attribute_name(text)),
            ),
        )

    def step(s: Sql, p: Sql) -> tuple[Sql, Sql, Sql]:
        stack, top = s["stack"], fn.element_at(s["stack"], -1)
        own = fn.filter(top["counts"], lambda c: c["name"] == p["name"])
        others = fn.filter(top["counts"], lambda c: c["name"] != p["name"])
        nth = fn.coalesce(fn.get(own, 0)["n"], 0) + 1
        grown = struct(
            path=top["path"],
            counts=fn.concat(others, fn.array(struct(name=p["name"], n=nth))),
        )
        child = struct(
            path=fn.concat(top["path"], "/", p["name"], "[", nth.cast("string"), "]"),
            counts=empty("struct<name:string,n:int>"),
        )
        below = fn.slice(stack, 1, fn.size(stack) - 1)
        after = struct(
            # the document itself is never closed
            stack=when(p["does"].isin(["value", "none", "name"]), stack)
            .when(p["does"] == "open", fn.concat(below, fn.array(grown, child)))
            .when(p["does"] == "empty", fn.concat(below, fn.array(grown)))
            .when(fn.size(stack) > 1, below)
            .otherwise(stack),
            attribute=when(p["does"].isin(["value", "none"]), s["attribute"]).otherwise(
                p["attribute"]
            ),
        )
        path = when(
            p["does"] == "value", fn.concat(top["path"], "/@", s["attribute"])
        ).otherwise(top["path"])
        return after, lit(True), path

    state = f"struct<stack:array<struct<path:string,counts:{_COUNTS}>>,attribute:string>"
    document = struct(path=lit(""), counts=empty("struct<name:string,n:int>"))
    zero = fn.named_struct(
        "stack", fn.array(document), "attribute", lit(None).cast("string")
    )
    return fold_some(fn.transform(parts, move), zero.cast(state), step, "string")


def _attribute_name(markup: Sql) -> Sql:
    """Name of the attribute a markup piece leads up to (``... name`` before ``=``)."""
    found = fn.regexp_extract(markup, r"([A-Za-z_:][^ \t\r\n=<>\"']*)[ \t\r\n]*$", 1)
    return fn.nullif(found, "")


def redact_markup(
    df: DataFrame,
    policy: Policy,
    text: str = "html",
    key: str | None = None,
    html: bool = True,
    dictionaries: Sequence[Pattern] = (),
    with_paths: bool = True,
) -> DataFrame:
    """Adds ``redacted_text`` and ``spans`` (relative to their node, with ``path``).

    Row-local; paths are computed only for documents that have spans.
    """
    policy.validate()
    cut = df.withColumn("_parts", segments(col(text), html).column())
    cut = cut.withColumn("_places", reading(col("_parts"), html).column())
    cut = cut.withColumn("_reading", reading_text(col("_places")).column())
    found = detection.with_spans(
        cut, patterns_for(policy, dictionaries), "_reading", "_found", policy.block
    )
    document = col(key) if key else None
    found = found.withColumn("_found", policy.keep(col("_found")).column()).withColumn(
        "_news", new_texts(policy, col("_found"), document).column()
    )
    # spans that touch a value, clipped to it; the replacement goes to the first
    starts, ends = (lambda p: p["s"]["start"]), (lambda p: p["s"]["end"])

    def hits_in(bands: Sql, place: Sql) -> Sql:
        begin, end = place["at"], place["at"] + fn.length(place["text"])
        return fn.transform(
            touching(bands, begin, end, starts, ends),
            lambda p: struct(
                start=fn.greatest(p["s"]["start"] - begin, 0),
                end=fn.least(p["s"]["end"], end) - begin,
                label=p["s"]["label"],
                text=p["s"]["text"],
                score=p["s"]["score"],
                new_text=when(p["s"]["start"] >= begin, p["n"]).otherwise(""),
                first=p["s"]["start"] >= begin,
            ),
        )

    pairs = fn.zip_with(col("_found"), col("_news"), lambda s, n: struct(s=s, n=n))
    # what lambdas use is bound: the optimizer may put the expression of a column in its place,
    # and a lambda would evaluate that for each element
    changed = let(
        banded(pairs, starts, ends),
        lambda bands: fn.filter(
            fn.transform(
                col("_places"),
                lambda p: struct(seg=p["seg"], text=p["text"], hits=hits_in(bands, p)),
            ),
            lambda c: fn.size(c["hits"]) > 0,
        ),
    )
    found = found.withColumn("_changed", fn.array_sort(changed).column())
    rewritten = fn.transform(
        col("_changed"),
        lambda c: struct(
            seg=c["seg"],
            text=splice(
                c["text"], c["hits"], fn.transform(c["hits"], lambda h: h["new_text"])
            ),
        ),
    )
    found = found.withColumn("_rewritten", rewritten.column())
    # unchanged runs between changed segments are copied as they are
    edges = fn.concat(
        fn.array(lit(-1)),
        fn.transform(col("_rewritten"), lambda r: r["seg"]),
        fn.array(fn.size(col("_parts"))),
    )
    found = found.withColumn("_edges", edges.column())
    runs = let(
        struct(parts=col("_parts"), edges=col("_edges"), rewritten=col("_rewritten")),
        lambda v: fn.transform(
            indices(fn.size(v["edges"]) - 1),
            lambda i: fn.concat(
                fn.array_join(
                    fn.transform(
                        part(
                            v["parts"],
                            v["edges"][i] + 1,
                            v["edges"][i + 1] - v["edges"][i] - 1,
                        ),
                        lambda p: p["text"],
                    ),
                    "",
                ),
                fn.coalesce(fn.get(v["rewritten"], i)["text"], ""),
            ),
        ),
    )
    new_document = when(
        fn.size(col("_rewritten")) > 0, fn.array_join(runs, "")
    ).otherwise(col(text))
    path_of = paths(col("_parts"), html) if with_paths else empty("string")
    found = found.withColumn(
        "_paths", when(fn.size(col("_found")) > 0, path_of).otherwise(empty("string")).column()
    )
    spans = let(
        col("_paths"),
        lambda known: fn.flatten(
            fn.transform(
                col("_changed"),
                lambda c: fn.transform(
                    fn.filter(c["hits"], lambda h: h["first"]),
                    lambda h: struct(
                        start=h["start"],
                        end=h["start"] + fn.length(h["text"]),
                        label=h["label"],
                        text=h["text"],
                        score=h["score"],
                        path=fn.get(known, c["seg"]),
                        new_text=h["new_text"],
                    ),
                ),
            )
        ),
    )
    helpers = [c for c in found.columns if c.startswith("_")]
    return found.withColumns(
        {
            "redacted_text": when(col(text).is_not_null(), new_document).column(),
            "spans": when(col(text).is_not_null(), spans).column(),
        }
    ).drop(*helpers)


__all__ = ["SEGMENT", "STANDIN", "paths", "reading", "reading_text", "redact_markup", "segments"]
