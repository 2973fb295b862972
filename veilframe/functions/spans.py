"""Spans: find them, resolve overlaps, splice replacements.

Offsets are code-point indices, end exclusive, as Spark's ``length``/``substring`` count
them.  A *candidate* is the struct in ``CANDIDATE``; its field order is its sort order
(start, longest first, highest score first, label), which is what overlap resolution
needs.  A *span* is the public struct in ``SPAN``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce


from .arrays import PIECE, banded, empty, fold_emit, fold_some, indices, let, part, running_starts, touching
from .sql import Sql, fn, lit, struct, when

CANDIDATE = "struct<start:int,neg_end:int,neg_score:double,label:string,text:string>"
SPAN = (
    "struct<start:int,end:int,label:string,text:string,score:double,"
    "language:string,path:string>"
)
REPLACEMENT = (
    "struct<start:int,end:int,label:string,text:string,score:double,"
    "language:string,path:string,new_start:int,new_end:int,new_text:string>"
)

# Two Unicode noncharacters.  MARK delimits matches while a text is being
# cut; a text that already holds it has it swapped for STANDIN (same length, and detection
# offsets only are taken from the swapped copy).
MARK = "￿"
STANDIN = "￾"


@dataclass(frozen=True)
class Pattern:
    """One regular expression that yields spans of ``label``.

    ``prefix`` is context that must precede the value but is not part of the span.
    ``accept`` is a predicate on (value, text before, text after), each side up to the
    neighbouring match or the end of the text.
    ``needs`` names what a text must hold for ``body`` to match at all: any one of the
    literals of a tuple (byte search), or a regex.  Patterns that need the same thing
    share one test per text.  ``in_line`` says that the pattern
    matches no line end, and that it and ``accept`` decide the same whether the text begins
    and ends at a line end or goes on beyond it.
    """

    label: str
    body: str
    score: float = 0.9
    prefix: str | None = None
    accept: Callable[[Sql, Sql, Sql], Sql] | None = None
    needs: str | tuple[str, ...] | None = None
    in_line: bool = False


def mark_safe(text: Sql) -> Sql:
    return fn.replace(text, lit(MARK), lit(STANDIN))


def cut(text: Sql, body: str, prefix: str | None = None) -> Sql:
    """Text cut at the matches: ``[gap, match, gap, ..., match, gap]``.

    One regex pass writes marks around the matches and a literal split cuts at them; the
    number of elements is always odd and their concatenation is the text.
    """
    if prefix is None:
        marked = fn.regexp_replace(text, f"(?:{body})", f"{MARK}$0{MARK}")
    else:
        marked = fn.regexp_replace(text, f"({prefix})({body})", f"$1{MARK}$2{MARK}")
    return fn.split(marked, MARK, -1)


def _holds(text: Sql, needs: str | tuple[str, ...]) -> Sql:
    if isinstance(needs, str):
        return text.rlike(needs)
    return reduce(lambda a, b: a | b, [fn.contains(text, word) for word in needs])


_CUTTING = "struct<rule:int,label:string,neg_score:double,pieces:array<string>>"


def _cuttings(text: Sql, patterns: list[Pattern], rule_of: dict) -> Sql:
    """One struct per pattern that matches: its label, rule and the cut text."""

    def cutting(pattern: Pattern) -> Sql:
        regex = f"(?:{pattern.prefix or ''})(?:{pattern.body})"
        return struct(
            rule=rule_of[pattern.accept],
            label=pattern.label,
            neg_score=-float(pattern.score),
            pieces=when(
                text.rlike(regex), cut(text, pattern.body, pattern.prefix)
            ).otherwise(empty("string")),
        )

    by_need: dict[str | tuple[str, ...] | None, list[Pattern]] = {}
    for pattern in patterns:
        by_need.setdefault(pattern.needs, []).append(pattern)
    groups = []
    for needs, members in by_need.items():
        group = fn.array(*[cutting(p) for p in members])
        if needs is not None:
            group = when(_holds(text, needs), group).otherwise(empty(_CUTTING))
        groups.append(group)
    joined = groups[0] if len(groups) == 1 else fn.concat(*groups)
    return fn.filter(joined, lambda c: fn.size(c["pieces"]) > 1)


def cuttings(text: Sql, patterns: list[Pattern]) -> Sql:
    """``text`` (which must be ``mark_safe``) cut by every pattern that matches it."""
    return _cuttings(text, patterns, _rules(patterns))


def _rules(patterns: list[Pattern]) -> dict:
    return {r: i for i, r in enumerate(dict.fromkeys(p.accept for p in patterns))}


def located(cuts: Sql, patterns: list[Pattern]) -> Sql:
    """Candidates in the cut texts.

    Patterns contribute their cut text only; turning pieces into located candidates and
    checking them is written once for all, which keeps the expression small.
    """
    rule_of = _rules(patterns)

    def accepted(rule: Sql, value: Sql, before: Sql, after: Sql) -> Sql:
        checks = None
        for check, i in rule_of.items():
            if check is None:
                continue
            passes = check(value, before, after)
            checks = (
                when(rule == i, passes) if checks is None else checks.when(rule == i, passes)
            )
        return checks.otherwise(True)

    def locate(v: Sql) -> Sql:
        pieces, starts = v["pieces"], v["starts"]

        def passes(i: Sql) -> Sql:
            return accepted(
                v["rule"],
                pieces[i],
                pieces[i - 1],
                pieces[i + 1],
            )

        def candidate(i: Sql) -> Sql:
            return struct(
                start=starts[i],
                neg_end=-(starts[i] + fn.length(pieces[i])),
                neg_score=v["neg_score"],
                label=v["label"],
                text=pieces[i],
            )

        odd = indices(fn.size(pieces) - 1, step=2, first=1)
        if any(rule is not None for rule in rule_of):
            odd = fn.filter(odd, passes)
        return fn.transform(odd, candidate)

    with_starts = fn.transform(
        cuts,
        lambda c: struct(
            rule=c["rule"],
            label=c["label"],
            neg_score=c["neg_score"],
            pieces=c["pieces"],
            starts=running_starts(fn.transform(c["pieces"], lambda p: fn.length(p))),
        ),
    )
    return fn.flatten(fn.transform(with_starts, locate))


def candidates(text: Sql, patterns: list[Pattern]) -> Sql:
    """All matches of all patterns in ``text`` (which must be ``mark_safe``)."""
    if not patterns:
        return empty(CANDIDATE)
    return located(cuttings(text, patterns), patterns)


def resolve(found: Sql) -> Sql:
    """Keep non-overlapping candidates: leftmost, then longest, then best score."""

    def keep(last_end: Sql, c: Sql) -> tuple[Sql, Sql, Sql]:
        free = c["start"] >= last_end
        return when(free, -c["neg_end"]).otherwise(last_end), free, c

    def disjoint(bound: Sql) -> Sql:
        return when(
            fn.size(bound) > 1,
            fold_some(fn.array_sort(bound), lit(0), keep, CANDIDATE),
        ).otherwise(bound)

    return let(fn.filter(found, lambda c: -c["neg_end"] > c["start"]), disjoint)


def without_blocked(found: Sql, blocks: Sql) -> Sql:
    """Drop candidates that lie inside a block match of their own label.

    A candidate meets only the blocks that touch it, not all of them.
    """
    starts, ends = (lambda b: b["start"]), (lambda b: -b["neg_end"])

    def outside(bands: Sql) -> Sql:
        return fn.filter(
            found,
            lambda c: ~fn.exists(
                touching(bands, c["start"], -c["neg_end"], starts, ends),
                lambda b: (b["label"] == c["label"])
                & (b["start"] <= c["start"])
                & (b["neg_end"] <= c["neg_end"]),
            ),
        )

    return let(banded(fn.array_sort(blocks), starts, ends), outside)


def to_spans(
    found: Sql,
    original: Sql,
    language: Sql | None = None,
    path: Sql | None = None,
) -> Sql:
    language = lit(None).cast("string") if language is None else language
    path = lit(None).cast("string") if path is None else path
    return fn.transform(
        found,
        lambda c: struct(
            start=c["start"],
            end=-c["neg_end"],
            label=c["label"],
            text=when(
                fn.contains(c["text"], lit(STANDIN)),
                fn.substring(original, c["start"] + 1, -c["neg_end"] - c["start"]),
            ).otherwise(c["text"]),
            score=-c["neg_score"],
            language=language,
            path=path,
        ),
    )


def to_candidates(spans: Sql) -> Sql:
    """Spans supplied from outside, in the form ``resolve`` expects."""
    return fn.transform(
        spans,
        lambda s: struct(
            start=s["start"].cast("int"),
            neg_end=-s["end"].cast("int"),
            neg_score=-fn.coalesce(s["score"].cast("double"), lit(0.0)),
            label=s["label"],
            text=s["text"],
        ),
    )


def splice(text: Sql, spans: Sql, new_texts: Sql) -> Sql:
    """Text with ``spans[i]`` replaced by ``new_texts[i]`` (spans ordered, disjoint).

    Finding a character offset walks the text from its start, so the text is first cut
    to the stretch of every ``PIECE`` spans.
    """

    def stretch(v: Sql) -> Sql:
        def gap_and_new(s: Sql, j: Sql) -> Sql:
            return let(
                when(j > 0, v["spans"][j - 1]["end"]).otherwise(v["base"]),
                lambda prev: fn.concat(
                    fn.substring(v["text"], prev - v["base"] + 1, s["start"] - prev),
                    v["news"][j],
                ),
            )

        return fn.array_join(fn.transform(v["spans"], gap_and_new), "")

    def build(v: Sql) -> Sql:
        def run(i: Sql) -> Sql:
            size = fn.least(fn.size(v["spans"]) - i, PIECE)
            spans_here = part(v["spans"], i, size)
            base = when(i > 0, v["spans"][i - 1]["end"]).otherwise(0)
            return let(
                struct(spans=spans_here, news=part(v["news"], i, size), base=base),
                lambda p: let(
                    struct(
                        spans=p["spans"],
                        news=p["news"],
                        base=p["base"],
                        text=fn.substring(
                            v["text"],
                            p["base"] + 1,
                            fn.element_at(p["spans"], -1)["end"] - p["base"],
                        ),
                    ),
                    stretch,
                ),
            )

        parts = fn.transform(indices(fn.size(v["spans"]), PIECE), run)
        last = v["spans"][fn.size(v["spans"]) - 1]["end"]
        tail = fn.substring(v["text"], last + 1, fn.length(v["text"]) - last)
        return when(
            fn.size(v["spans"]) > 0, fn.concat(fn.array_join(parts, ""), tail)
        ).otherwise(v["text"])

    return let(struct(text=text, spans=spans, news=new_texts), build)


def with_new_offsets(spans: Sql, new_texts: Sql) -> Sql:
    """Spans plus where their replacements stand in the spliced text."""
    pairs = fn.zip_with(spans, new_texts, lambda s, n: struct(span=s, new=n))
    return fold_emit(
        pairs,
        lit(0),
        lambda shift, p: let(
            struct(s=p["span"], n=p["new"], at=p["span"]["start"] + shift),
            lambda v: struct(
                state=v["at"] + fn.length(v["n"]) - v["s"]["end"],
                emit=fn.array(
                    struct(
                        start=v["s"]["start"],
                        end=v["s"]["end"],
                        label=v["s"]["label"],
                        text=v["s"]["text"],
                        score=v["s"]["score"],
                        language=v["s"]["language"],
                        path=v["s"]["path"],
                        new_start=v["at"],
                        new_end=v["at"] + fn.length(v["n"]),
                        new_text=v["n"],
                    )
                ),
            ),
        ),
        REPLACEMENT,
    )


def restore(redacted: Sql, replacements: Sql) -> Sql:
    """Put the original texts back at the new offsets; the inverse of ``splice``."""
    back = fn.transform(
        replacements,
        lambda r: struct(start=r["new_start"], end=r["new_end"]),
    )
    return splice(redacted, back, fn.transform(replacements, lambda r: r["text"]))


def utf16_length(text: Sql) -> Sql:
    return (fn.length(fn.encode(text, "UTF-16BE")) / 2).cast("int")


def _wide_characters(text: Sql) -> Sql:
    """Positions of the characters that take two UTF-16 units, in bands."""
    pieces = fn.split(text, lit(r"[\x{10000}-\x{10FFFF}]"), -1)
    begins = running_starts(fn.transform(pieces, lambda p: fn.length(p) + 1))
    at = fn.transform(fn.slice(begins, 2, fn.size(begins)), lambda b: b - 1)
    return banded(at, lambda p: p, lambda p: p)


def utf16_spans(text: Sql, spans: Sql) -> Sql:
    """Spans with UTF-16 ``start``/``end``; the code-point offsets are kept beside them.

    An offset grows by one for every wide character before it; a text without any, which
    is most texts, keeps its offsets.
    """

    def shifted(bands: Sql, offset: Sql) -> Sql:
        def add(total: Sql, band: Sql) -> Sql:
            part_of = fn.size(fn.filter(band["items"], lambda p: p < offset))
            inside = when(band["high"] < offset, fn.size(band["items"]))
            return total + inside.when(band["low"] >= offset, 0).otherwise(part_of)

        return fn.aggregate(bands, offset, add)

    def located(bands: Sql) -> Sql:
        return fn.transform(
            spans,
            lambda s: struct(
                start=shifted(bands, s["start"]),
                end=shifted(bands, s["end"]),
                python_start=s["start"],
                python_end=s["end"],
                label=s["label"],
                text=s["text"],
                score=s["score"],
            ),
        )

    return let(_wide_characters(text), located)


def usage(text: Sql) -> Sql:
    """Number of words, the unit of usage."""
    return fn.size(fn.regexp_extract_all(text, lit("[^ \\t\\r\\n\\f\\x0B]+"), lit(0)))


def is_token_shape(text: Sql) -> Sql:
    return text.rlike(r"\[([A-Za-z0-9_]+)_[A-Za-z0-9]{1,64}\]")
