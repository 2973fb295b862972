"""Policy tables: one row per (dataset, label), the persistent form of ``Policy``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.sql import col
from ..options import from_json, to_json
from ..policy import Policy

SCHEMA = (
    "dataset string, label string, state string, options string, "
    "allow array<string>, block array<string>, custom array<string>, requested boolean, "
    "path_allow array<string>, settings string"
)
DEFAULT_ROW = "*"


def to_rows(spark: SparkSession, dataset: str, policy: Policy) -> DataFrame:
    """Rows of one policy; the default state is the row of label ``*``."""
    policy.validate()
    labels = dict.fromkeys(
        [
            *policy.config,
            *policy.options,
            *policy.allow,
            *policy.block,
            *policy.custom,
            *policy.custom_entities,
            *policy.path_allow,
        ]
    )
    # what holds for the whole policy; the type of the seed matters, as it keys the tokens
    settings = {
        "seed": policy.seed,
        "token_width": policy.token_width,
        "claim_off": policy.claim_off,
        "path_ignore": list(policy.path_ignore),
        "custom_entities": list(policy.custom_entities),
    }
    rows = [
        (dataset, DEFAULT_ROW, policy.default, None, [], [], [], None, [], json.dumps(settings))
    ]
    for label in labels:
        options = policy.options.get(label)
        rows.append(
            (
                dataset,
                label,
                policy.config.get(label),
                to_json(options) if options else None,
                list(policy.allow.get(label, [])),
                list(policy.block.get(label, [])),
                list(policy.custom.get(label, [])),
                label in policy.custom_entities,
                list(policy.path_allow.get(label, [])),
                None,
            )
        )
    return spark.createDataFrame(rows, SCHEMA)


def from_rows(rows: DataFrame, dataset: str) -> Policy:
    """Back from rows; a policy has at most a few rows per label."""
    config, options, lists = {}, {}, {n: {} for n in ("allow", "block", "custom", "path_allow")}
    default, settings, requested = model.REDACTION, {}, []
    for row in rows.where(F.col("dataset") == dataset).toLocalIterator():
        if row.label == DEFAULT_ROW:
            default = row.state or default
            settings = json.loads(row.settings or "{}")
            continue
        if row.state:
            config[row.label] = row.state
        if row.options:
            options[row.label] = from_json(row.options, row.label)
        for name, by_label in lists.items():
            if row[name]:
                by_label[row.label] = list(row[name])
        if row.requested:
            requested.append(row.label)
    # the order of the request, then labels that an edit has added
    named = [x for x in settings.pop("custom_entities", []) if x in requested]
    named += sorted(set(requested) - set(named))
    settings["path_ignore"] = tuple(settings.get("path_ignore", ()))
    return Policy(default, config, options, custom_entities=tuple(named), **lists, **settings)


def copied(policies: DataFrame, source: str, target: str, **edits: object) -> DataFrame:
    """Settings of ``source`` for ``target``; a copy excludes any other change."""
    given = [name for name, value in edits.items() if value is not None]
    if given:
        raise ValueError(f"copy excludes other settings: {given}")
    copy = policies.where(F.col("dataset") == source).withColumn("dataset", F.lit(target))
    return policies.where(F.col("dataset") != target).unionByName(copy)


def edited(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial edit: fields that are null in ``changes`` keep their old value."""
    old, new = policies.alias("old"), changes.alias("new")
    joined = old.join(
        new,
        (F.col("old.dataset") == F.col("new.dataset"))
        & (F.col("old.label") == F.col("new.label")),
        "full_outer",
    )
    return joined.select(
        F.coalesce("new.dataset", "old.dataset").alias("dataset"),
        F.coalesce("new.label", "old.label").alias("label"),
        *[
            (F.coalesce(f"new.{c}", f"old.{c}") if c in changes.columns else F.col(f"old.{c}")).alias(c)
            for c in policies.columns
            if c not in ("dataset", "label")
        ],
    )


def invalid_rows(policies: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Rows whose label or state is unknown; empty means valid.

    ``code`` (``label`` or ``state``) names the column at fault and is fixed; ``problem``
    is its message.
    """
    spark = policies.sparkSession
    known = spark.createDataFrame([(x,) for x in [DEFAULT_ROW, *model.LABELS]], "label string")
    if custom is not None:
        known = known.unionByName(custom.select("label"))
    unknown = policies.join(known, "label", "left_anti").withColumn("code", F.lit("label"))
    bad_state = policies.where(
        F.col("state").isNotNull() & ~F.col("state").isin(model.STATES)
    ).withColumn("code", F.lit("state"))
    return unknown.unionByName(bad_state).withColumn(
        "problem", F.concat(F.lit("unknown "), F.col("code"))
    )


def enabled(dataset_entities: DataFrame, dataset: str, label: str) -> DataFrame:
    """(dataset, label) rows plus the pair."""
    spark = dataset_entities.sparkSession
    pair = spark.createDataFrame([(dataset, label)], "dataset string, label string")
    return dataset_entities.unionByName(
        pair.join(dataset_entities, ["dataset", "label"], "left_anti")
    )


def disabled(dataset_entities: DataFrame, dataset: str, label: str) -> DataFrame:
    return dataset_entities.where(
        ~((F.col("dataset") == dataset) & (F.col("label") == label))
    )


def states(spans: DataFrame, policies: DataFrame, dataset: str) -> DataFrame:
    """Long spans with their effective state, by the policy table.

    A dataset has a few rows per label: they are read once and compiled into a ``CASE``,
    so the spans need no join.
    """
    own = from_rows(policies, dataset)
    return spans.withColumn("state", own.state(col("label")).column())
