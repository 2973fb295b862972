"""Dictionary entities from a gazetteer table ``(label, term)`` of any size.

The terms form a trie of words.  From every word of a text it is walked as far as the text
agrees with some term, so the cost follows the matches and not the longest term.  A trie that
is counted and small goes to every task and is walked inside the row; the hits are an array
beside the text, without a shuffle.  A larger one stays a table (node, word, child) and is
walked by joins, one level a round, with the places that are still alive: a round per
word of the longest match found.  The terms are computed once, into a durable table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model, pools
from ..functions.arrays import indices, running_starts
from ..functions.spans import cut, mark_safe
from ..functions.sql import Sql, col, fn, lit, struct, when
from ..session import BROADCAST_CHARS, BROADCAST_ROWS, checkpoint_dir, hot_split_join, settle

_WORD = r"[\p{L}\p{N}]++(?:['’-][\p{L}\p{N}]++)*+"
#: The node that every walk begins at.
ROOT = ""


def key_of(text: Sql) -> Sql:
    """Lower-case words joined by single blanks: how terms and runs are compared."""
    return fn.array_join(fn.regexp_extract_all(fn.lower(text), _WORD, 0), " ")


def keyed(gazetteer: DataFrame) -> DataFrame:
    """(label, key, n_words), one row per distinct pair."""
    return (
        gazetteer.select("label", key_of(col("term")).column().alias("key"))
        .where("key <> ''")
        .distinct()
        .withColumn("n_words", F.size(F.split("key", " ")))
    )


def default_gazetteer(spark) -> DataFrame:
    """The pools of the generators as a gazetteer."""
    lists = {
        "NAME_GIVEN": pools.MALE_NAMES + pools.FEMALE_NAMES,
        "NAME_FAMILY": pools.FAMILY_NAMES,
        "LOCATION_CITY": pools.CITIES,
    }
    rows = [(label, term) for label, terms in lists.items() for term in terms]
    return spark.createDataFrame(rows, "label string, term string")


def trie(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The terms (label, key) as nodes (node, word, child) and finals (node, label).

    A node is named by the digest of the words that lead to it, so equal beginnings of terms
    are one node without any numbering.
    """
    # (name of the node before, word, name of the node) of each word of a term
    steps = fn.aggregate(
        fn.split(col("key"), " "),
        fn.array().cast("array<struct<node:string,word:string,child:string>>"),
        lambda path, word: fn.concat(
            path,
            fn.array(
                struct(
                    node=_last(path),
                    word=word,
                    child=fn.md5(fn.concat(_last(path), lit("\0"), word)),
                )
            ),
        ),
    )
    paths = settle(terms.select("label", steps.column().alias("path")))
    nodes = paths.select(F.explode("path").alias("s")).select("s.*").distinct()
    finals = paths.select(F.element_at("path", -1)["child"].alias("node"), "label").distinct()
    return settle(nodes), finals


def _last(path: Sql) -> Sql:
    return when(fn.size(path) > 0, fn.element_at(path, -1)["child"]).otherwise(lit(ROOT))


_FOUND = "array<struct<start:int,end:int,label:string>>"


def _nested(rows: list) -> dict:
    """(label, key) rows as nested dictionaries; the labels of a term lie under the key ''."""
    root: dict = {}
    for label, key in rows:
        node = root
        for word in key.split(" "):
            node = node.setdefault(word, {})
        node.setdefault("", []).append(label)
    return root


def walked(text: Column, rows: list) -> Column:
    """(start, end, label) of all terms in a text, by the trie of ``rows`` (label, key)."""
    words = regex.compile(_WORD)

    @F.pandas_udf(_FOUND)
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        root = _nested(rows)
        for batch in batches:
            out = []
            for value in batch:
                found = []
                places = [] if value is None else [m.span() for m in words.finditer(value)]
                lowered = [value[b:e].lower() for b, e in places]
                for i, word in enumerate(lowered):
                    node, j = root.get(word), i
                    while node is not None:
                        for label in sorted(node.get("", ())):
                            found.append({"start": places[i][0], "end": places[j][1], "label": label})
                        j += 1
                        node = node.get(lowered[j]) if j < len(lowered) else None
                out.append(None if value is None else found)
            yield pd.Series(out, dtype=object)

    return walk(text)


def words_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, start, end, word): the words of each text in order, in lower case."""
    pieces, starts = col("_pieces"), col("_starts")
    placed = df.select(key, text).withColumn(
        "_pieces", cut(mark_safe(col(text)), _WORD).column()
    ).withColumn("_starts", running_starts(fn.transform(pieces, lambda p: fn.length(p))).column())
    words = fn.transform(
        indices(fn.size(pieces) - 1, step=2, first=1),
        lambda i: struct(
            i=(i / 2).cast("int"),
            start=starts[i],
            end=starts[i] + fn.length(pieces[i]),
            word=fn.lower(pieces[i]),
        ),
    )
    return placed.select(key, F.explode(words.column()).alias("_w")).select(
        key, "_w.i", "_w.start", "_w.end", "_w.word"
    )


def _stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/veilframe-words-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def walked_by_joins(df: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, start, end) of all terms in all texts, by the trie as a table."""
    nodes, finals = trie(terms)
    labels = settle(finals.groupBy("node").agg(F.sort_array(F.collect_set("label")).alias("labels")))
    words = _stored(words_of(df, key, text))
    heads = nodes.where(F.col("node") == ROOT).select("word", F.col("child").alias("node"))
    counted = settle(
        heads.join(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word")
    )
    alive = hot_split_join(
        words.select(key, "i", "start", "end", "word"), counted, "word", "node", "n", "i"
    ).where(F.col("node").isNotNull()).drop("word")
    after = words.select(key, F.col("i").alias("_i"), F.col("end").alias("_end"), F.col("word").alias("_word"))
    steps = nodes.select(F.col("node").alias("_node"), F.col("word").alias("_step"), "child")
    hits = None
    while True:
        # lineage is cut each round: a round reads what the one before has written
        alive = _stored(alive)
        if not alive.take(1):
            break
        here = alive.join(labels, "node").select(
            key, F.explode("labels").alias("label"), "start", "end"
        )
        hits = here if hits is None else hits.unionByName(here)
        following = alive.join(
            after, (alive[key] == after[key]) & (F.col("i") + 1 == F.col("_i"))
        ).select(alive[key], F.col("_i").alias("i"), "start", F.col("_end").alias("end"), "node", "_word")
        alive = following.join(
            steps, (F.col("node") == F.col("_node")) & (F.col("_word") == F.col("_step"))
        ).select(key, "i", "start", "end", F.col("child").alias("node"))
    if hits is None:
        return words.limit(0).select(key, F.col("word").alias("label"), "start", "end")
    return hits


def _small_terms(gazetteer: DataFrame) -> tuple[DataFrame, list | None]:
    """The distinct terms as a durable table, and as rows if they are few."""
    terms = settle(keyed(gazetteer).where("label IS NOT NULL").select("label", "key"))
    n_terms, n_chars = terms.agg(
        F.count(F.lit(1)), F.sum(F.length("label") + F.length("key"))
    ).first()
    if n_terms > BROADCAST_ROWS or (n_chars or 0) > BROADCAST_CHARS:
        return terms, None
    return terms, [tuple(r) for r in terms.select("label", "key").collect()]


def gazetteer_hits(
    df: DataFrame,
    gazetteer: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    score: float = model.SCORE_DICTIONARY,
    inline: bool = True,
) -> DataFrame:
    """(key, label, start, end, score): one row per gazetteer term found in a text.
    ``inline`` False walks by joins whatever the number of terms."""
    terms, rows = _small_terms(gazetteer)
    if rows is not None and inline:
        found = df.select(key, F.explode(walked(F.col(text), rows)).alias("_h")).select(
            key, "_h.label", "_h.start", "_h.end"
        )
    else:
        renamed = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
        found = walked_by_joins(renamed, terms, "_id", "_text").withColumnRenamed("_id", key)
    return found.select(key, "label", "start", "end", F.lit(float(score)).alias("score"))


def with_gazetteer(
    df: DataFrame,
    gazetteer: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    out: str = "extra",
    score: float = model.SCORE_DICTIONARY,
    inline: bool = True,
) -> DataFrame:
    """``df`` plus an array of dictionary spans per document (null or empty where none); in
    place, without a shuffle, if the terms are few."""
    spans = fn.transform(
        col("_h"),
        lambda h: struct(
            start=h["start"],
            end=h["end"],
            label=h["label"],
            text=fn.substring(col(text), h["start"] + 1, h["end"] - h["start"]),
            score=lit(float(score)),
            language=lit(None).cast("string"),
            path=lit(None).cast("string"),
        ),
    )
    terms, rows = _small_terms(gazetteer)
    if rows is not None and inline:
        found = df.withColumn("_h", walked(F.col(text), rows))
    else:
        renamed = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
        hits = walked_by_joins(renamed, terms, "_id", "_text").withColumnRenamed("_id", key)
        grouped = hits.groupBy(key).agg(
            F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("_h")
        )
        found = df.join(grouped, key, "left")
    return found.withColumn(out, when(col("_h").is_not_null(), spans).column()).drop("_h")
