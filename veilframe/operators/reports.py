"""Reports over detected spans: counts, examples, occurrences, mappings, usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.spans import usage
from ..functions.sql import col, fn, lit, struct, when
from ..functions.synth import synthesize
from ..functions.tokens import token
from ..options import generator_of
from ..policy import Policy
from .ordered import dense_index, prefix_sum

#: Characters of context on each side of an occurrence, and records per page.
CONTEXT_CHARS = 50
PAGE_SIZE = 1000


def exploded(spans: str) -> Column:
    """Explode of a computed array without letting the optimizer copy its expression.

    Exploding a bare column adds ``size(column) > 0`` below, where the column's defining
    expression is repeated; a trivial wrapper keeps detection to one evaluation.
    """
    return F.explode(fn.filter(col(spans), lambda s: lit(True)).column())


def long_spans(df: DataFrame, keys: Sequence[str], spans: str = "spans") -> DataFrame:
    """(keys..., start, end, label, text, score): one row per span."""
    return df.select(*keys, exploded(spans).alias("_s")).select(
        *keys, "_s.start", "_s.end", "_s.label", "_s.text", "_s.score"
    )


def counts(df: DataFrame, file: str, spans: str = "spans") -> DataFrame:
    """(file, label, n).  Partial sums per task, so a file that fills the data is cheap."""
    return (
        df.select(file, exploded(spans).alias("_s"))
        .groupBy(file, F.col("_s.label").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_maps(df: DataFrame, file: str, spans: str = "spans") -> DataFrame:
    """(file, counts MAP<label, n>)."""
    per_label = counts(df, file, spans)
    return per_label.groupBy(file).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("counts")
    )


def examples(
    df: DataFrame,
    file: str,
    order: Sequence[str],
    spans: str = "spans",
    k: int = 5,
) -> DataFrame:
    """First ``k`` spans per (file, label), by ``order`` then start.

    The rank limit is applied per task before the shuffle, so a hot file sends at most
    ``k`` rows per task.
    """
    rows = df.select(file, *order, exploded(spans).alias("_s")).select(
        file,
        *order,
        F.col("_s.label").alias("label"),
        F.col("_s.text").alias("text"),
        F.col("_s.start").alias("start_index"),
        F.col("_s.end").alias("end_index"),
    )
    window = Window.partitionBy(file, "label").orderBy(*order, "start_index")
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def occurrences(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    spans: str = "spans",
    labels: Sequence[str] | None = None,
    width: int = CONTEXT_CHARS,
) -> DataFrame:
    """(keys..., label, entity, head, tail, start): spans with the text around them."""
    wanted = list(labels) if labels is not None else model.LABELS
    kept = fn.filter(col(spans), lambda s: s["label"].isin(wanted))
    with_context = fn.transform(
        kept,
        lambda s: struct(
            label=s["label"],
            entity=s["text"],
            head=fn.right(fn.substring(col(text), 1, s["start"]), width),
            tail=fn.substring(col(text), s["end"] + 1, width),
            start=s["start"],
        ),
    )
    return df.select(*keys, F.explode(with_context.column()).alias("_o")).select(
        *keys, "_o.*"
    )


def paged(
    df: DataFrame, order: str, groups: Sequence[str] = (), size: int = PAGE_SIZE
) -> DataFrame:
    """Numbers records of each group across ``order`` rows: ``record``, ``page``.

    ``df`` has one row per (group, order) with an array column ``items``; records are
    numbered by prefix sums of the array sizes, so no group is sorted in one task.  The
    frame is read twice (sizes, then items): ``settle`` it when it is costly to compute.
    """
    sized = prefix_sum(df, groups, order, F.size("items").cast("bigint"), "_before")
    listed = sized.select(
        *groups,
        order,
        "_before",
        F.posexplode(fn.filter(col("items"), lambda x: lit(True)).column()).alias("_i", "item"),
    )
    return listed.select(
        *groups,
        order,
        "item",
        (F.col("_before") + F.col("_i")).alias("record"),
        F.floor((F.col("_before") + F.col("_i")) / size).alias("page"),
    )


def page_totals(df: DataFrame, groups: Sequence[str] = (), size: int = PAGE_SIZE) -> DataFrame:
    """(groups..., total_records, total_pages) of the frame given to ``paged``."""
    n = F.sum(F.size("items").cast("bigint"))
    return df.groupBy(*groups).agg(
        n.alias("total_records"), F.ceil(n / size).alias("total_pages")
    )


def page(
    df: DataFrame,
    order: Sequence[str],
    after: Sequence[object] | None = None,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """One page of records in ``order`` after the continuation key ``after``.

    The key of the last record is the next continuation key; its absence on a page
    shorter than ``size`` ends the listing.
    """
    rows = df
    if after is not None:
        rows = rows.where(
            F.struct(*[F.col(c) for c in order])
            > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, after)])
        )
    return rows.orderBy(*order).limit(size)


def mappings(
    df: DataFrame,
    policy: Policy,
    keys: Sequence[str],
    spans: str = "spans",
    row_number: str | None = None,
    column_index: str | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Entity mappings: each span with its token, its synthetic value and the output.

    Nulls where a label's state does not produce that value.  With ``keep_empty`` a row
    without spans stays, with nulls: the files of the report need no second scan.
    """
    text, label = col("_s.text"), col("_s.label")
    state = policy.state(label)
    names = [n for n in dict.fromkeys([*model.LABELS, *policy.custom_entities])]
    by_kind: dict[tuple, list[str]] = {}
    for name in names:
        options = policy.options.get(name)
        kind = generator_of(name, options)
        own = kind in ("Name", "HipaaAddressGenerator") or options is not None
        by_kind.setdefault((kind, name if own else None), []).append(name)
    synthetic = None
    for members in by_kind.values():
        new = synthesize(text, members[0], policy.options.get(members[0]), policy.seed)
        hit = label.isin(members)
        synthetic = when(hit, new) if synthetic is None else synthetic.when(hit, new)
    synthetic = synthetic.otherwise(synthesize(text, "", None, policy.seed))
    tokenised = token(label, text, policy.seed, policy.token_width)
    places = [c for c in (row_number, column_index) if c]
    if keep_empty:
        whole = F.explode_outer(fn.filter(col(spans), lambda s: lit(True)).column())
        found = df.select(*keys, *places, whole.alias("_s"))
        state = when(col("_s.label").is_not_null(), state)
    else:
        found = df.select(*keys, *places, exploded(spans).alias("_s"))
    found = found.withColumn("_state", state.column())
    redacts = col("_state") == model.REDACTION
    made_up = col("_state").isin([s for s in model.STATES if s.endswith("Synthesis")])
    found = found.withColumns(
        {
            "redacted_text": when(redacts, tokenised).column(),
            "synthetic_text": when(made_up, synthetic).column(),
        }
    )
    return found.select(
        *keys,
        F.col("_s.label").alias("label"),
        F.col("_s.text").alias("text"),
        "redacted_text",
        "synthetic_text",
        F.col("_state").alias("applied_state"),
        F.coalesce("redacted_text", "synthetic_text", F.col("_s.text")).alias("output_text"),
        (F.col(row_number) if row_number else F.lit(None)).cast("int").alias("row_number"),
        (F.col(column_index) if column_index else F.lit(None)).cast("int").alias("column_index"),
        F.col("_s.score").alias("score"),
        F.col("_s.start").alias("start"),
    )


def files_with_mappings(
    files: DataFrame, entity_rows: DataFrame, file: str
) -> DataFrame:
    """Every file with its mappings; files without entities stay, with nulls.

    The long form of the grouped report: one row per (file, mapping), so a file with most
    of the entities is not collected into one cell.
    """
    return files.join(entity_rows, file, "left")


def file_sizes(
    df: DataFrame, file: str, text: str = "text", spans: str = "spans"
) -> DataFrame:
    """(file, words, redacted_words, bytes, hash) per row of a redacted frame."""
    inside = fn.aggregate(
        fn.transform(col(spans), lambda s: usage(s["text"])),
        lit(0),
        lambda acc, n: acc + n,
    )
    return df.select(
        file,
        usage(col(text)).column().alias("words"),
        inside.column().alias("redacted_words"),
        F.octet_length(text).alias("bytes"),
        F.base64(F.unhex(F.md5(text))).alias("hash"),
    )


def first_seen(
    found: DataFrame, keys: list[str], order: str, label: str = "label", text: str = "text"
) -> DataFrame:
    """(keys, label, position, text): the distinct texts of each label in the order in which
    they are first seen, from 0.

    ``order`` is a non-negative integer that tells the spans of a group apart.  Repeats are
    reduced to their least position before the shuffle, and positions are counted in blocks,
    so any group and label may hold any share of the spans.
    """
    first = found.groupBy(*keys, label, text).agg(F.min(order).alias("_first"))
    return dense_index(first, [*keys, label], "_first", "position").select(
        *keys, label, "position", text
    )
