"""Redaction: spans in, replacements out; splice and offsets.

``redact_text`` is one Sql expression (detect, choose, splice), so it works in a
``select``, over a stream, or per element of an array, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.arrays import let
from ..functions.spans import Pattern, splice, usage, with_new_offsets
from ..functions.sql import Sql, col, fn, struct, when
from ..functions.synth import synthesize
from ..functions.tokens import token
from ..options import generator_of
from ..policy import Policy
from . import detect as detection
from .linking import representative


def patterns_for(
    policy: Policy, dictionaries: Sequence[Pattern] = ()
) -> list[Pattern]:
    """The detectors of a policy, built-in and its own.

    Labels that are off take part in overlap resolution (their spans are dropped later)
    unless the policy says ``claim_off=False``, which leaves their detectors out.
    """
    requested = detection.requested_rules(policy.custom, policy.custom_entities)
    every = [*detection.BUILTIN, *dictionaries, *detection.rules(policy.allow), *requested]
    return [p for p in every if policy.claim_off or policy.is_on(p.label)]


def replacement_for(
    policy: Policy, label: Sql, text: Sql, document: Sql | None, linked: Sql
) -> Sql:
    """New text of one span: a ``CASE`` over the states and generators in use.

    ``linked`` is the representative of the span's group (grouped synthesis).
    """
    seed = policy.seed
    tokenised = token(label, text, seed, policy.token_width)
    names = list(dict.fromkeys([*model.LABELS, *policy.custom_entities, *policy.config]))
    by_plan: dict[tuple, list[str]] = {}
    for name in names:
        state = policy.state_of(name)
        if state in (model.OFF, model.REDACTION):
            continue
        options = policy.options.get(name)
        kind = generator_of(name, options)
        sensitive_to_label = kind in ("Name", "HipaaAddressGenerator")
        key = (state, kind, name if sensitive_to_label or options else None)
        by_plan.setdefault(key, []).append(name)

    fallback = tokenised
    if policy.default not in (model.OFF, model.REDACTION):
        fallback = synthesize(text, "", None, seed, document)
    redacted = [n for n, state in policy.config.items() if state == model.REDACTION]
    result = when(label.isin(redacted), tokenised) if redacted else None
    for (state, _, _), members in by_plan.items():
        source = linked if state == model.GROUPING_SYNTHESIS else text
        key = f"{seed}|context" if state == model.REPLACEMENT_SYNTHESIS else seed
        name = members[0]
        new = synthesize(source, name, policy.options.get(name), key, document)
        chosen = label == name if len(members) == 1 else label.isin(members)
        result = when(chosen, new) if result is None else result.when(chosen, new)
    return fallback if result is None else result.otherwise(fallback)


def new_texts(policy: Policy, spans: Sql, document: Sql | None = None) -> Sql:
    states = {policy.default, *policy.config.values()}
    grouped = model.GROUPING_SYNTHESIS in states

    def build(bound: Sql) -> Sql:
        return fn.transform(
            bound,
            lambda s: replacement_for(
                policy,
                s["label"],
                s["text"],
                document,
                representative(s, bound) if grouped else s["text"],
            ),
        )

    return let(spans, build)


def apply_spans(
    df: DataFrame,
    policy: Policy,
    text: str = "text",
    spans: str = "spans",
    key: str | None = None,
) -> DataFrame:
    """Adds ``redacted_text`` and ``usage``; ``spans`` become replacements."""
    news = new_texts(policy, col("_spans"), col(key) if key else None)
    step = df.withColumn("_spans", policy.keep(col(spans)).column()).withColumn(
        "_news", news.column()
    )
    return step.withColumns(
        {
            "redacted_text": splice(col(text), col("_spans"), col("_news")).column(),
            "usage": usage(col(text)).column(),
            spans: when(
                col(text).is_not_null(), with_new_offsets(col("_spans"), col("_news"))
            ).column(),
        }
    ).drop("_spans", "_news")


def redact_frame(
    df: DataFrame,
    policy: Policy,
    text: str = "text",
    key: str | None = None,
    dictionaries: Sequence[Pattern] = (),
    language: str | None = None,
    extra: str | None = None,
) -> DataFrame:
    """Adds ``redacted_text``, ``usage`` and ``spans`` to a frame of texts.

    Row-local: no shuffle, whatever the size of the frame.  Null texts stay null.
    """
    policy.validate()
    found = df
    if extra is not None:
        found = found.withColumn("_extra", policy.keep(col(extra)).column())
    found = detection.with_spans(
        found,
        patterns_for(policy, dictionaries),
        text,
        block=policy.block,
        language=language,
        extra="_extra" if extra is not None else None,
    )
    return apply_spans(found.drop("_extra"), policy, text, key=key)


def redact_known(
    df: DataFrame,
    policy: Policy,
    text: str = "text",
    spans: str = "spans",
    key: str | None = None,
) -> DataFrame:
    """Redact with caller-supplied entities; detection is skipped."""
    policy.validate()
    kept = detection.known_entities(col(text), policy.keep(col(spans)))
    return apply_spans(df.withColumn(spans, kept.column()), policy, text, spans, key)


def redact_columns(
    columns: Sequence[str], policy: Policy, dictionaries: Sequence[Pattern] = ()
) -> Callable[[DataFrame], DataFrame]:
    """For ``df.transform``: each named text column is replaced by its redaction."""

    def run(df: DataFrame) -> DataFrame:
        for c in columns:
            renamed = df.withColumnRenamed(c, "_text")
            done = redact_frame(renamed, policy, "_text", None, dictionaries)
            df = done.withColumn(c, F.col("redacted_text")).select(*df.columns)
        return df

    return run


def redact_structured(
    columns: Mapping[str, str],
    options: Mapping[str, object] | None = None,
    seed: int | str | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """For ``df.transform``: whole-value synthesis of a column -> label map."""
    options = options or {}

    def run(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: synthesize(col(c), label, options.get(c), seed).column()
                for c, label in columns.items()
            }
        )

    return run


def override(
    original: Sql,
    replacements: Sql,
    functions: Mapping[str, Callable[[Sql], Sql]],
) -> Sql:
    """Post-hoc override of chosen labels in a redacted response.

    ``functions[label]`` maps a replacement struct to its new text; other labels keep
    theirs.  Returns ``struct(redacted_text, spans)`` with fresh offsets.
    """

    def chosen(s: Sql) -> Sql:
        result = s["new_text"]
        for label, function in functions.items():
            result = when(s["label"] == label, function(s)).otherwise(result)
        return result

    def build(v: Sql) -> Sql:
        return struct(
            redacted_text=splice(v["text"], v["spans"], v["news"]),
            spans=with_new_offsets(v["spans"], v["news"]),
        )

    return let(
        struct(
            text=original, spans=replacements, news=fn.transform(replacements, chosen)
        ),
        build,
    )
