"""Markdown chunks for retrieval.

``split_markdown`` cuts a text at headers, level by level: only sections still longer
than the limit go one level deeper, and after the sixth level they are cut at the last
newline before the limit (the newline is dropped), else at the limit.  Each level is one
projection over the sections of a document, so the split needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import (
    banded,
    empty,
    fold_emit,
    indices,
    let,
    running_starts,
    touching,
)
from ..functions.spans import MARK, mark_safe
from ..functions.sql import Sql, col, fn, lit, struct, when
from ..policy import Policy

MAX_HEADER_DEPTH = 6
DEFAULT_MAX_CHARS = 15_000

SECTION = "struct<start:int,end:int,headers:array<string>>"


def _split_section(text: Sql, section: Sql, level: int) -> Sql:
    """Sections of one section, cut at headers of up to ``level`` signs.

    The header trail keeps its first ``level - 1`` entries and appends the new header,
    whatever its own number of signs.
    """
    size = section["end"] - section["start"]
    body = fn.substring(text, section["start"] + 1, size)
    header = rf"(?mdU)^#{{1,{level}}}\s+.*$"
    marked = fn.regexp_replace(body, header, f"{MARK}$0{MARK}")

    def headed(pieces: Sql) -> Sql:
        def walk(v: Sql) -> Sql:
            def step(trail: Sql, i: Sql) -> Sql:
                title = fn.regexp_extract(v["p"][i], r"(?U)^#+\s+((?s:.*))$", 1)
                longer = fn.concat(fn.slice(trail, 1, level - 1), fn.array(title))
                # a header piece and the text up to the next one form a section
                end = when(
                    i + 2 < fn.size(v["p"]), section["start"] + fn.get(v["s"], i + 2)
                ).otherwise(section["end"])
                return struct(
                    state=longer,
                    emit=fn.array(
                        struct(
                            start=section["start"] + v["s"][i], end=end, headers=longer
                        )
                    ),
                )

            rest = fold_emit(
                indices(fn.size(v["p"]) - 1, step=2, first=1),
                section["headers"],
                step,
                SECTION,
            )
            lead = struct(
                start=section["start"],
                end=section["start"] + fn.length(v["p"][0]),
                headers=section["headers"],
            )
            return when(
                fn.length(v["p"][0]) > 0, fn.concat(fn.array(lead), rest)
            ).otherwise(rest)

        starts = running_starts(fn.transform(pieces, lambda p: fn.length(p)))
        return let(struct(p=pieces, s=starts), walk)

    return let(fn.split(marked, MARK, -1), headed)


def _cut_long(text: Sql, section: Sql, limit: int) -> Sql:
    """A section without usable headers: cut at newlines, else hard."""
    size = section["end"] - section["start"]
    rounds = size.cast("int")

    def step(at: Sql, _: Sql) -> Sql:
        window = fn.substring(text, section["start"] + at + 1, limit)
        back = fn.locate("\n", fn.reverse(window))
        newline = at + limit - back
        done = at >= size
        last = at + limit >= size
        at_newline = (back > 0) & (newline > at)

        def piece(end: Sql) -> Sql:
            return fn.array(
                struct(
                    start=section["start"] + at,
                    end=section["start"] + end,
                    headers=section["headers"],
                )
            )

        return (
            when(done, struct(state=at, emit=empty(SECTION)))
            .when(last, struct(state=size, emit=piece(size)))
            .when(at_newline, struct(state=newline + 1, emit=piece(newline)))
            .otherwise(struct(state=at + limit, emit=piece(at + limit)))
        )

    # A newline just after a cut can make a piece as short as one character, so the
    # number of pieces is bounded by the lines plus the hard cuts.
    lines = fn.length(
        fn.substring(text, section["start"] + 1, size)
    ) - fn.length(
        fn.replace(fn.substring(text, section["start"] + 1, size), "\n", "")
    )
    bound = lines + fn.ceil(size / limit).cast("int") + 1
    return fold_emit(fn.sequence(lit(1), fn.least(bound, rounds + 1)), lit(0), step, SECTION)


def split_markdown(
    df: DataFrame, text: str = "text", max_chars: int = DEFAULT_MAX_CHARS
) -> DataFrame:
    """Adds ``sections``: an array of (start, end, headers) that covers the text."""
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    safe = "_vf_md"
    step = df.withColumn(safe, mark_safe(col(text)).column())
    whole = fn.array(
        struct(start=0, end=fn.length(col(safe)), headers=empty("string"))
    )
    step = step.withColumn(
        "sections",
        when(fn.length(col(safe)) > 0, whole).otherwise(empty(SECTION)).column(),
    )

    def long(s: Sql) -> Sql:
        return s["end"] - s["start"] > max_chars

    for level in range(1, MAX_HEADER_DEPTH + 1):
        # the first level always applies; deeper ones only to over-long sections
        deeper = fn.flatten(
            fn.transform(
                col("sections"),
                lambda s: (
                    _split_section(col(safe), s, 1)
                    if level == 1
                    else when(long(s), _split_section(col(safe), s, level)).otherwise(
                        fn.array(s)
                    )
                ),
            )
        )
        step = step.withColumn("sections", deeper.column())
    cut = fn.flatten(
        fn.transform(
            col("sections"),
            lambda s: when(long(s), _cut_long(col(safe), s, max_chars)).otherwise(
                fn.array(s)
            ),
        )
    )
    return step.withColumn("sections", cut.column()).drop(safe)


def intersects(span: Sql, start: Sql, end: Sql) -> Sql:
    """Closed on both sides: touching counts; ``end`` -1 is open."""
    return ((span["start"] <= end) | (end == -1)) & (span["end"] >= start)


def is_sensitive(
    spans: Sql, labels: Sequence[str], start: Sql | int = 0, end: Sql | int = -1
) -> Sql:
    """Whether a span of one of ``labels`` meets the range."""
    low = start if isinstance(start, Sql) else lit(start)
    high = end if isinstance(end, Sql) else lit(end)
    return fn.exists(
        spans, lambda s: s["label"].isin(list(labels)) & intersects(s, low, high)
    )


def entity_texts(spans: Sql) -> Sql:
    """Map label -> distinct texts, labels and texts in first-seen order."""

    def texts(label: Sql) -> Sql:
        own = fn.filter(spans, lambda s: s["label"] == label)
        return fn.array_distinct(fn.transform(own, lambda s: s["text"]))

    labels = fn.array_distinct(fn.transform(spans, lambda s: s["label"]))
    return fn.map_from_entries(
        fn.transform(labels, lambda x: struct(key=x, value=texts(x)))
    )


def moved_borders(borders: Sql, spans: Sql) -> Sql:
    """Where ascending offsets of the original stand in the redacted text; inside a replaced
    span, at the replacement's end, so that a span cut in two goes whole to the chunk where
    it starts.

    One fold over borders and spans in order carries the last replacement.
    """
    event = "struct<at:int,kind:int,end:int,new_end:int>"
    marks = fn.concat(
        fn.transform(
            borders,
            lambda b: struct(
                at=b, kind=lit(0), end=lit(None).cast("int"), new_end=lit(None).cast("int")
            ),
        ),
        fn.coalesce(
            fn.transform(
                spans,
                lambda s: struct(at=s["start"], kind=lit(1), end=s["end"], new_end=s["new_end"]),
            ),
            empty(event),
        ),
    )

    def step(last: Sql, e: Sql) -> Sql:
        moved = (
            when(last["end"].is_null(), e["at"])
            .when(last["end"] > e["at"], last["new_end"])
            .otherwise(e["at"] + last["new_end"] - last["end"])
        )
        return when(e["kind"] == 1, struct(state=e, emit=empty("int"))).otherwise(
            struct(state=last, emit=fn.array(moved))
        )

    return fold_emit(fn.array_sort(marks.cast(f"array<{event}>")), lit(None).cast(event), step, "int")


def chunks(
    df: DataFrame,
    policy: Policy,
    text: str = "text",
    spans: str = "spans",
    key: str = "doc_id",
    max_chars: int = DEFAULT_MAX_CHARS,
    metadata_labels: Sequence[str] = (),
    include_metadata: bool = True,
    redacted: str | None = None,
) -> DataFrame:
    """(key, chunk_no, start, end, text, is_sensitive[, headers, entities]).

    The original text is split and spans are compared in its offsets.  With
    ``redacted`` (the column written by ``apply_spans``, whose ``spans`` carry new
    offsets) the chunk text is taken from the redacted text over the mapped range.
    """
    labels = list(metadata_labels)
    sensitive = policy.enabled_labels()
    starts, ends = (lambda s: s["start"]), (lambda s: s["end"])
    bands = banded(col(spans), starts, ends)
    cut = split_markdown(df, text, max_chars).withColumn("_bands", bands.column())
    if redacted:
        borders = fn.flatten(
            fn.transform(col("sections"), lambda s: fn.array(s["start"], s["end"]))
        )
        cut = cut.withColumn("_moved", moved_borders(borders, col(spans)).column())

    def near(start: Sql, end: Sql) -> Sql:
        # closed on both sides: widen the half-open range by one
        return touching(col("_bands"), start - 1, end + 1, starts, ends)

    def chunk(section: Sql, i: Sql) -> Sql:
        start, end = section["start"], section["end"]
        if redacted:
            first, last = col("_moved")[i * 2], col("_moved")[i * 2 + 1]
            ranged = fn.substring(col(redacted), first + 1, last - first)
        else:
            ranged = fn.substring(col(text), start + 1, end - start)

        def filled(hits: Sql) -> Sql:
            fields = {
                "start": start,
                "end": end,
                "text": ranged,
                "is_sensitive": fn.exists(hits, lambda s: s["label"].isin(sensitive)),
            }
            if include_metadata:
                fields["headers"] = section["headers"]
                fields["entities"] = entity_texts(
                    fn.filter(hits, lambda s: s["label"].isin(labels))
                )
            return struct(**fields)

        return let(near(start, end), filled)

    # chunks are cut inside the row and exploded once finished: the text of a document
    # is not copied per chunk
    made = fn.transform(col("sections"), chunk)
    return cut.select(key, F.posexplode(made.column()).alias("chunk_no", "_c")).select(
        key, "chunk_no", "_c.*"
    )
