"""JSON text of unknown shape: leaves with paths, redaction in place.

A document is cut into tokens once; a fold over the tokens keeps the path.  Redaction
replaces leaf values at their exact ranges, so order, spacing, numbers and everything
that is not sensitive stay byte for byte.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.arrays import (
    banded,
    empty,
    fold_some,
    indices,
    let,
    part,
    running_starts,
    touching,
)
from ..functions.spans import MARK, STANDIN, Pattern, mark_safe, splice
from ..functions.sql import Sql, col, fn, lit, struct, when
from ..policy import Policy
from . import detect as detection
from .redact import new_texts, patterns_for

# Escape pairs are masked before cutting (two characters for two), so a string is a plain
# run up to the next quote; a regex that steps over escapes itself recurses per escape and
# overflows the stack on long strings.
_ESCAPE = r"(?s)\\."
_STRING = r'"[^"]*+"'
_NUMBER = r"-?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?"
_BLANK = r"[ \t\r\n]*+"
_VALUE = rf"{_STRING}(?!{_BLANK}:)|{_NUMBER}|true|false|null|[\[\]{{}}]"
# a value or bracket with the key before it; a key without a value stands alone
_TOKEN = rf"((?:{_STRING}{_BLANK}:{_BLANK})?+)({_VALUE})|({_STRING}{_BLANK}:)"

LEAF = "struct<path:string,kind:string,value:string,start:int,end:int>"


def decode(raw: Sql) -> Sql:
    """Text of a JSON string literal."""
    return fn.get_json_object(fn.concat('{"v":', raw, "}"), "$.v")


def encode(text: Sql) -> Sql:
    """JSON string literal of a text."""
    whole = fn.to_json(fn.named_struct("v", text))
    return fn.substring(whole, 6, fn.length(whole) - 6)


def _kind(token: Sql) -> Sql:
    first = fn.left(token, 1)
    return (
        when(first == '"', "string")
        .when(first.isin(["{", "[", "}", "]", ""]), first)
        .when(first == "n", "null")
        .when(first.isin(["t", "f"]), "boolean")
        .otherwise("number")
    )


def _component(key: Sql) -> Sql:
    """A key as a step of a path."""
    named = when(key.rlike(r"^[\p{L}\p{N}_-]+$"), fn.concat(".", key)).otherwise(
        fn.concat("['", key, "']")
    )
    return fn.coalesce(named, "")


_STATE = "struct<end:int,here:string,base:string,at:int,up:array<struct<base:string,at:int>>>"


def leaves(text: Sql) -> Sql:
    """Primitive values of a JSON text in document order."""
    masked = fn.regexp_replace(mark_safe(text), _ESCAPE, STANDIN * 2)
    marked = fn.regexp_replace(masked, f"(?s)(?:{_TOKEN})", f"{MARK}$1$3{MARK}$2{MARK}")

    def plain(literal: Sql) -> Sql:
        return fn.substring(literal, 2, fn.length(literal) - 2)

    def tokens(pieces: Sql) -> Sql:
        # gap, key, value, gap, key, value, ..., gap; all commas outside strings are in gaps
        def token(i: Sql) -> Sql:
            gap, key, value = pieces[i], pieces[i + 1], pieces[i + 2]
            literal = fn.concat(fn.substring_index(key, '"', 2), '"')
            bare = let(plain(literal), _component)
            return struct(
                gap=fn.length(gap),
                commas=fn.length(gap) - fn.length(fn.replace(gap, ",", "")),
                escaped=fn.contains(key, STANDIN),
                key=when(fn.contains(key, STANDIN), literal).when(key != "", bare),
                begin=fn.length(gap) + fn.length(key),
                size=fn.length(value),
                kind=_kind(value),
                value=value,
            )

        return fn.transform(indices(fn.size(pieces) - 1, step=3), token)

    def original(literal: Sql, start: Sql) -> Sql:
        return decode(fn.substring(text, start + 1, fn.length(literal)))

    def step(state: Sql, t: Sql) -> tuple[Sql, Sql, Sql]:
        # state: where the next gap begins, the path here, that of the open container, the
        # index in it (-1: an object), and path and index of the containers around it.
        # One case per field: binding the new state would copy all of it at every token.
        depth = fn.size(state["up"])
        inside = depth > 0
        keyed = t["key"].is_not_null() & inside
        counted = (t["commas"] > 0) & (state["at"] >= 0)
        key = when(
            t["escaped"],
            let(original(t["key"], state["end"] + t["gap"]), _component),
        ).otherwise(t["key"])
        at = when(keyed, -1).when(counted, state["at"] + t["commas"]).otherwise(state["at"])
        here = (
            when(keyed, fn.concat(state["base"], key))
            .when(
                counted,
                fn.concat(state["base"], "[", (state["at"] + t["commas"]).cast("string"), "]"),
            )
            .otherwise(state["here"])
        )
        opens, closes = t["kind"].isin(["{", "["]), t["kind"].isin(["}", "]"]) & inside
        outer = fn.element_at(state["up"], -1)
        after = struct(
            end=state["end"] + t["begin"] + t["size"],
            here=when(t["kind"] == "[", fn.concat(here, "[0]"))
            .when(closes, state["base"])
            .otherwise(here),
            base=when(opens, here).when(closes, outer["base"]).otherwise(state["base"]),
            at=when(t["kind"] == "{", -1)
            .when(t["kind"] == "[", 0)
            .when(closes, outer["at"])
            .otherwise(at),
            up=when(
                opens, fn.concat(state["up"], fn.array(struct(base=state["base"], at=at)))
            )
            .when(closes, fn.slice(state["up"], 1, depth - 1))
            .otherwise(state["up"]),
        )
        begin = state["end"] + t["begin"]
        string = when(fn.contains(t["value"], STANDIN), original(t["value"], begin)).otherwise(
            plain(t["value"])
        )
        leaf = struct(
            path=here,
            kind=t["kind"],
            value=when(t["kind"] == "string", string)
            .when(t["kind"] == "null", lit(None).cast("string"))
            .otherwise(t["value"]),
            start=begin,
            end=begin + t["size"],
        )
        return after, t["kind"].isin(["string", "number", "boolean", "null"]), leaf

    zero = struct(end=0, here="$", base="$", at=-1, up=fn.array()).cast(_STATE)
    return fold_some(let(fn.split(marked, MARK, -1), tokens), zero, step, LEAF)


def path_regex(path: str) -> str:
    """A JSONPath (keys, indices, ``*`` and ``..``) as a regex over leaf paths."""
    out = ["^\\$"]
    rest = path[1:] if path.startswith("$") else path
    while rest:
        if rest.startswith("..*"):
            out.append(".*")
            rest = rest[3:]
        elif rest.startswith(".."):
            name = re.match(r"\.\.([^.\[]+)", rest)
            out.append(r"(?:.*)\." + re.escape(name.group(1)) if name else ".*")
            rest = rest[name.end():] if name else rest[2:]
        elif rest.startswith("[*]"):
            out.append(r"\[[0-9]+\]")
            rest = rest[3:]
        elif rest.startswith(".*"):
            out.append(r"(?:\.[^.\[]+|\['.*?'\])")
            rest = rest[2:]
        else:
            part = re.match(r"\.[^.\[]+|\[[^\]]*\]", rest)
            if part is None:
                raise ValueError(f"not a JSONPath: {path}")
            out.append(re.escape(part.group(0).replace('"', "'")))
            rest = rest[part.end():]
    return "".join(out) + "$"


def path_label(path: Sql, rules: Mapping[str, Sequence[str]]) -> Sql:
    """Label a path rule gives to a leaf; the smallest label when several do."""
    result: Sql = lit(None).cast("string")
    for label in sorted(rules, reverse=True):
        regex = "|".join(f"(?:{path_regex(p)})" for p in rules[label])
        result = when(path.rlike(regex), label).otherwise(result)
    return result


def explode_leaves(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, path, kind, value): one row per primitive value."""
    return df.select(key, F.explode(leaves(col(text)).column()).alias("_l")).select(
        key, "_l.path", "_l.kind", "_l.value"
    )


def redact_json(
    df: DataFrame,
    policy: Policy,
    text: str = "json",
    key: str | None = None,
    dictionaries: Sequence[Pattern] = (),
) -> DataFrame:
    """Adds ``redacted_text`` (still the same JSON shape) and ``spans`` with paths.

    Path rules beat detection and lists; ignored paths never change.  Offsets of spans
    are relative to the leaf value.
    """
    policy.validate()
    step = df.withColumn("_leaves", leaves(col(text)).column())

    def tagged(leaf: Sql) -> Sql:
        skip = lit(False)
        if policy.path_ignore:
            regex = "|".join(f"(?:{path_regex(p)})" for p in policy.path_ignore)
            skip = leaf["path"].rlike(regex)
        return struct(
            path=leaf["path"],
            kind=leaf["kind"],
            value=fn.coalesce(leaf["value"], ""),
            start=leaf["start"],
            end=leaf["end"],
            skip=skip | (leaf["kind"] == "null"),
            label=path_label(leaf["path"], policy.path_allow),
        )

    step = step.withColumn("_leaves", fn.transform(col("_leaves"), tagged).column())
    lengths = fn.transform(col("_leaves"), lambda x: fn.length(x["value"]) + 1)
    step = step.withColumns(
        {
            "_at": running_starts(lengths).column(),
            "_reading": fn.array_join(
                fn.transform(col("_leaves"), lambda x: x["value"]), "\n"
            ).column(),
        }
    )
    found = detection.with_spans(
        step, patterns_for(policy, dictionaries), "_reading", "_spans", policy.block
    )

    starts, ends = (lambda s: s["start"]), (lambda s: s["end"])

    def own_spans(bands: Sql, leaf: Sql, begin: Sql) -> Sql:
        end = begin + fn.length(leaf["value"])
        inside = fn.filter(
            touching(bands, begin, end, starts, ends),
            lambda s: (s["start"] >= begin) & (s["end"] <= end),
        )
        detected = fn.transform(
            inside,
            lambda s: struct(
                start=s["start"] - begin,
                end=s["end"] - begin,
                label=s["label"],
                text=s["text"],
                score=s["score"],
                path=leaf["path"],
            ),
        )
        whole = fn.array(
            struct(
                start=0,
                end=fn.length(leaf["value"]),
                label=leaf["label"],
                text=leaf["value"],
                score=float(model.SCORE_PATH_RULE),
                path=leaf["path"],
            )
        )
        kind = "struct<start:int,end:int,label:string,text:string,score:double,path:string>"
        return (
            when(leaf["skip"] | (fn.length(leaf["value"]) == 0), empty(kind))
            .when(leaf["label"].is_not_null(), whole)
            .otherwise(detected)
        )

    def hits_in(bands: Sql) -> Sql:
        return fn.filter(
            fn.zip_with(
                col("_leaves"),
                col("_at"),
                lambda leaf, at: struct(leaf=leaf, spans=policy.keep(own_spans(bands, leaf, at))),
            ),
            lambda h: fn.size(h["spans"]) > 0,
        )

    # bound: in a lambda the optimizer may put the detection itself in place of its column
    hits = let(banded(col("_spans"), starts, ends), hits_in)
    found = found.withColumn("_hits", hits.column())
    document = col(key) if key else None
    found = found.withColumn(
        "_all", fn.flatten(fn.transform(col("_hits"), lambda h: h["spans"])).column()
    ).withColumn("_news", new_texts(policy, col("_all"), document).column())
    counts = fn.transform(col("_hits"), lambda h: fn.size(h["spans"]))
    found = found.withColumn("_first", running_starts(counts).column())

    def rewritten(v: Sql, h: Sql, i: Sql) -> Sql:
        news = part(v["news"], v["first"][i], fn.size(h["spans"]))
        value = splice(h["leaf"]["value"], h["spans"], news)
        number = h["leaf"]["kind"] == "number"
        keeps = number & value.rlike(r"^-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?$")
        return struct(
            start=h["leaf"]["start"],
            end=h["leaf"]["end"],
            text=when(keeps, value).otherwise(encode(value)),
        )

    changes = let(
        struct(news=col("_news"), first=col("_first")),
        lambda v: fn.transform(col("_hits"), lambda h, i: rewritten(v, h, i)),
    )
    found = found.withColumn("_changes", changes.column())
    out = splice(
        col(text), col("_changes"), fn.transform(col("_changes"), lambda c: c["text"])
    )
    spans = fn.zip_with(
        col("_all"),
        col("_news"),
        lambda s, n: struct(
            start=s["start"],
            end=s["end"],
            label=s["label"],
            text=s["text"],
            score=s["score"],
            path=s["path"],
            new_text=n,
        ),
    )
    helpers = [c for c in found.columns if c.startswith("_")]
    return found.withColumns(
        {
            "redacted_text": when(col(text).is_not_null(), out).column(),
            "spans": when(col(text).is_not_null(), spans).column(),
        }
    ).drop(*helpers)
