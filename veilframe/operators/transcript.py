"""Transcripts: per-segment redaction and time intervals to mute.

A transcript is one row (``TRANSCRIPT_SCHEMA``); all steps are expressions over its
arrays, so the work is spread by rows and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import (
    banded,
    empty,
    fold_emit,
    fold_piece,
    let,
    pieces_of,
    touching,
)
from ..functions.spans import Pattern
from ..functions.sql import Sql, col, fn, lit, struct, when
from ..policy import Policy
from .conversation import redact_rows, rejoin

_WORD = "struct<start:double,end:double,word:string>"
_ALIGNED = "struct<start:double,end:double,word:string,char_start:int,char_end:int>"

#: Milliseconds added before and after a muted interval.
PAD_BEFORE = 250.0
PAD_AFTER = 250.0


def redact_transcripts(
    df: DataFrame,
    policy: Policy,
    key: str = "doc_id",
    dictionaries: Sequence[Pattern] = (),
) -> DataFrame:
    """(key, segment, original_text, redacted_text, spans) per segment."""
    texts = fn.transform(col("segments"), lambda s: s["text"])
    segments = df.select(key, F.posexplode(texts.column()).alias("segment", "text"))
    return redact_rows(segments, policy, [key], "segment", dictionaries=dictionaries)


def redacted_text(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Full text: redacted segments joined by newlines."""
    return rejoin(segments, [key], "segment")


def words(segments: Sql) -> Sql:
    """Words of all segments in order; a word repeated across a segment border is kept
    once (same start, end and word as the last word so far)."""

    def step(last: Sql, segment: Sql) -> Sql:
        own = fn.coalesce(segment["words"], empty(_WORD))
        repeated = (fn.size(own) > 0) & fn.equal_null(fn.get(own, 0), last)
        kept = when(repeated, fn.slice(own, 2, fn.size(own))).otherwise(own)
        return struct(
            state=when(
                fn.size(kept) > 0, fn.element_at(kept, -1)
            ).otherwise(last),
            emit=kept,
        )

    return fold_emit(segments, lit(None).cast(_WORD), step, _WORD)


def align(text: Sql, spoken: Sql) -> Sql:
    """Character range of each word, searched left to right; words not found drop out.

    Every piece of words searches the text that is left, not the whole text again.
    """

    def search(v: Sql) -> Sql:
        def step(at: Sql, w: Sql) -> Sql:
            found = fn.locate(w["word"], v["rest"], at + 1)
            size = fn.length(w["word"])
            return when(
                found > 0,
                struct(
                    state=found - 1 + size,
                    emit=fn.array(
                        struct(
                            start=w["start"],
                            end=w["end"],
                            word=w["word"],
                            char_start=v["base"] + found - 1,
                            char_end=v["base"] + found - 1 + size,
                        )
                    ),
                ),
            ).otherwise(struct(state=at, emit=empty(_ALIGNED)))

        return let(
            fold_piece(v["piece"], lit(0), step, _ALIGNED),
            lambda r: struct(state=v["base"] + r["state"], emit=r["out"]),
        )

    def piece_step(base: Sql, piece: Sql) -> Sql:
        rest = fn.substring(text, base + 1, fn.length(text))
        return let(struct(base=base, piece=piece, rest=rest), search)

    return fold_emit(pieces_of(spoken), lit(0), piece_step, _ALIGNED)


def with_aligned_words(df: DataFrame) -> DataFrame:
    """Adds ``words`` (deduplicated, with character ranges) to transcripts."""
    return df.withColumn("_words", words(col("segments")).column()).withColumn(
        "words", align(col("text"), col("_words")).column()
    ).drop("_words")


_INTERVAL = "struct<span:int,start:double,end:double>"


def _found_intervals(spans: Sql, bands: Sql) -> Sql:
    """(span, start, end) of every span that touches a word, in order."""
    starts, ends = (lambda w: w["char_start"]), (lambda w: w["char_end"])

    def interval(s: Sql, i: Sql) -> Sql:
        hit = touching(bands, s["start"], s["end"], starts, ends)
        return let(
            hit,
            lambda h: struct(
                span=i,
                start=fn.array_min(fn.transform(h, lambda w: w["start"])),
                end=fn.array_max(fn.transform(h, lambda w: w["end"])),
            ),
        )

    return fn.filter(fn.transform(spans, interval), lambda x: x["start"].is_not_null())


def _with_bands(df: DataFrame, key: str, spans: str, *more: str) -> DataFrame:
    starts, ends = (lambda w: w["char_start"]), (lambda w: w["char_end"])
    return df.select(
        key, spans, *more, banded(col("words"), starts, ends).column().alias("_bands")
    )


def intervals(df: DataFrame, key: str = "doc_id", spans: str = "spans") -> DataFrame:
    """(key, span, start, end) in milliseconds for every span that touches a word.

    A partly covered word is muted whole; spans that touch no word drop out.
    """
    found = _found_intervals(col(spans), col("_bands"))
    return _with_bands(df, key, spans).select(key, F.explode(found.column()).alias("_i")).select(
        key, "_i.span", "_i.start", "_i.end"
    )


def mute_list(
    df: DataFrame,
    duration: str,
    key: str = "doc_id",
    spans: str = "spans",
    before: float | None = None,
    after: float | None = None,
) -> DataFrame:
    """(key, start, end): intervals widened, kept inside the recording (``duration`` in
    milliseconds) and joined where they overlap or touch.  All inside the row: a recording is
    never dealt anew."""
    low = PAD_BEFORE if before is None else before
    high = PAD_AFTER if after is None else after
    found = _found_intervals(col(spans), col("_bands"))
    wide = fn.transform(
        found,
        lambda i: struct(
            start=fn.greatest(i["start"] - lit(float(low)), lit(0.0)),
            end=fn.least(i["end"] + lit(float(high)), col(duration).cast("double")),
        ),
    )
    # one expression inside the explode: a projection between would be merged into the lambda
    # and find the bands again for every span
    joined = _joined(fn.array_sort(wide)).column()
    return _with_bands(df, key, spans, duration).select(key, F.explode(joined).alias("_m")).select(
        key, "_m.start", "_m.end"
    )


def padded(
    df: DataFrame,
    duration: str,
    before: float = PAD_BEFORE,
    after: float = PAD_AFTER,
) -> DataFrame:
    """Mute list: intervals widened, kept inside the recording."""
    return df.withColumns(
        {
            "start": F.greatest(F.col("start") - before, F.lit(0.0)),
            "end": F.least(F.col("end") + after, F.col(duration).cast("double")),
        }
    )


def _joined(ordered: Sql) -> Sql:
    """Sorted intervals, overlapping or touching ones joined, in one fold."""
    kind = "struct<start:double,end:double>"

    def step(open_: Sql, item: Sql) -> Sql:
        joins = item["start"] <= open_["end"]
        wider = struct(start=open_["start"], end=fn.greatest(open_["end"], item["end"]))
        first = open_["start"].is_null()
        return (
            when(first, struct(state=item, emit=empty(kind)))
            .when(joins, struct(state=wider, emit=empty(kind)))
            .otherwise(struct(state=item, emit=fn.array(open_)))
        )

    nothing = struct(start=lit(None).cast("double"), end=lit(None).cast("double"))
    # a far sentinel closes the last open interval
    far = struct(start=lit("Infinity").cast("double"), end=lit("Infinity").cast("double"))
    return fold_emit(fn.concat(ordered, fn.array(far)), nothing, step, kind)


def merged(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping or touching intervals of a recording joined into one, for intervals that
    come as rows; ``mute_list`` does it where the recording lies."""
    grouped = df.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_i")
    )
    return grouped.select(key, F.explode(_joined(col("_i")).column()).alias("_m")).select(
        key, "_m.start", "_m.end"
    )
