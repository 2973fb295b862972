"""Linking: entities of a document that name the same thing, one representative each.

An entity belongs to the longest entity of its label family whose words contain its own
words as a run ("Smith" -> "John Smith"); ties go to the earliest.  Instead of comparing
entities pairwise, every entity offers each run of its words once and the best offer per
run wins, so the work is linear in the entities and partial aggregation shrinks it
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.arrays import indices, let
from ..functions.sql import Sql, col, fn, lit, struct, when

# Words that do not tell entities apart.
HONORIFICS = "mr mrs ms miss dr prof sir madam mister".split()


def words_of(text: Sql) -> Sql:
    """Lower-case words without punctuation and honorifics."""
    cleaned = fn.regexp_replace(fn.lower(text), r"[^\p{L}\p{N}@]+", " ")
    words = fn.filter(fn.split(fn.trim(cleaned), " ", -1), lambda w: w != "")
    plain = fn.filter(words, lambda w: ~w.isin(HONORIFICS))
    return when(fn.size(plain) > 0, plain).otherwise(words)


def family_of(label: Sql) -> Sql:
    return (
        when(label.isin(model.PERSON_LABELS), lit("person"))
        .when(label.isin(model.PLACE_LABELS), lit("place"))
        .otherwise(label)
    )


def representative(span: Sql, spans: Sql) -> Sql:
    """Text that stands for ``span`` among the spans of one row."""
    mine = fn.concat(lit(" "), fn.array_join(words_of(span["text"]), " "), lit(" "))

    def rank(s: Sql) -> Sql:
        return struct(
            words=fn.size(words_of(s["text"])), at=-s["start"], text=s["text"]
        )

    def contains(s: Sql, own: Sql) -> Sql:
        theirs = fn.concat(lit(" "), fn.array_join(words_of(s["text"]), " "), lit(" "))
        return (family_of(s["label"]) == family_of(span["label"])) & fn.contains(
            theirs, own
        )

    best = let(
        mine,
        lambda own: fn.array_max(
            fn.transform(fn.filter(spans, lambda s: contains(s, own)), rank)
        ),
    )
    return fn.coalesce(best["text"], span["text"])


def _runs(words: Sql) -> Sql:
    """All contiguous runs of the words, joined by blanks."""
    return fn.array_distinct(
        fn.flatten(
            fn.transform(
                indices(fn.size(words)),
                lambda i: fn.transform(
                    fn.sequence(lit(1), fn.size(words) - i),
                    lambda n: fn.array_join(fn.slice(words, i + 1, n), " "),
                ),
            )
        )
    )


def group_entities(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``spans`` (key, start, label, text, ...) with ``representative`` and its start.

    One aggregation and one join, both on (document, family, words): no pairs and no
    per-document collection.
    """
    named = spans.withColumns(
        {
            "_words": words_of(col("text")).column(),
            "_family": family_of(col("label")).column(),
        }
    )
    offers = named.select(
        key,
        "_family",
        F.explode(_runs(col("_words")).column()).alias("_run"),
        F.struct(
            F.size("_words").alias("words"),
            (-F.col("start")).alias("at"),
            F.col("text").alias("text"),
        ).alias("_rank"),
    )
    best = offers.groupBy(key, "_family", "_run").agg(F.max("_rank").alias("_best"))
    return (
        named.withColumn("_run", F.array_join("_words", " "))
        .join(best, [key, "_family", "_run"], "left")
        .select(
            *[F.col(c) for c in spans.columns],
            F.coalesce(F.col("_best.text"), F.col("text")).alias("representative"),
            F.coalesce(-F.col("_best.at"), F.col("start")).alias("group_start"),
        )
    )
