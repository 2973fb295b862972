"""Reports, quality, manifests, policy tables and the request log."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilframe.operators import manifest, policies, quality, reports, request_log
from veilframe.operators.detect import builtin, with_spans
from veilframe.operators.redact import redact_known
from veilframe.policy import Policy
from veilframe.session import settle

from .common import (
    SEED,
    STANDALONE,
    candidates_sql,
    documents,
    int_sql,
    main_spans,
    query,
    resolved_sql,
    table,
    token_sql,
)

# --- reports --------------------------------------------------------------------------

_BY_SOURCE = resolved_sql(keys="doc_id, source")


@query(
    "A1_counts",
    _BY_SOURCE + " SELECT source, label, count(*) AS n FROM resolved GROUP BY ALL",
)
def counts(spark, sf_dir):
    return reports.counts(main_spans(spark, sf_dir), "source")


@query(
    "A1_count_maps",
    _BY_SOURCE
    + """, c AS (SELECT source, label, count(*) AS n FROM resolved GROUP BY ALL)
      SELECT source, string_agg(label || '=' || n, ',' ORDER BY label) AS counts FROM c GROUP BY source""",
)
def count_maps(spark, sf_dir):
    maps = reports.count_maps(main_spans(spark, sf_dir), "source")
    return maps.select(
        "source",
        F.expr(
            "array_join(array_sort(transform(map_entries(counts), e -> e.key || '=' || e.value)), ',')"
        ).alias("counts"),
    )


@query(
    "A2_examples",
    _BY_SOURCE
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY doc_id, start) AS rank FROM resolved)
      SELECT source, label, doc_id, value AS text, start AS start_index, stop AS end_index, rank FROM r WHERE rank <= 2""",
)
def examples(spark, sf_dir):
    return reports.examples(main_spans(spark, sf_dir), "source", ["doc_id"], k=2)


@query(
    "A3_occurrences",
    resolved_sql()
    + """ SELECT doc_id, label, value AS entity, start,
          substr(text, greatest(start - 49, 1), least(start, 50)) AS head, substr(text, stop + 1, 50) AS tail
        FROM resolved WHERE label IN ('EMAIL_ADDRESS', 'CREDIT_CARD', 'PHONE_NUMBER')""",
)
def occurrences(spark, sf_dir):
    wanted = ["EMAIL_ADDRESS", "CREDIT_CARD", "PHONE_NUMBER"]
    return reports.occurrences(main_spans(spark, sf_dir), ["doc_id"], labels=wanted)


@query(
    "A4_paged_occurrences",
    _BY_SOURCE
    + """, n AS (SELECT source, doc_id, label, value AS text,
          row_number() OVER (PARTITION BY source ORDER BY doc_id, start) - 1 AS record FROM resolved)
      SELECT source, doc_id, label, text, record, CAST(record // 3 AS BIGINT) AS page FROM n""",
)
def paged_occurrences(spark, sf_dir):
    found = settle(
        main_spans(spark, sf_dir).select("source", "doc_id", F.col("spans").alias("items"))
    )
    paged = reports.paged(found, "doc_id", ["source"], size=3)
    return paged.select("source", "doc_id", "item.label", "item.text", "record", "page")


@query(
    "A4_page_totals",
    _BY_SOURCE
    + """, n AS (SELECT source, count(*) AS n FROM resolved GROUP BY source),
      s AS (SELECT DISTINCT source FROM documents)
      SELECT source, coalesce(n, 0) AS total_records, CAST(ceil(coalesce(n, 0) / 3) AS BIGINT) AS total_pages
      FROM s LEFT JOIN n USING (source)""",
)
def page_totals(spark, sf_dir):
    found = main_spans(spark, sf_dir).select("source", "doc_id", F.col("spans").alias("items"))
    return reports.page_totals(found, ["source"], size=3)


@query(
    "A4_keyset_page",
    resolved_sql()
    + """ SELECT doc_id, start, label, value AS text FROM resolved
        WHERE (doc_id, start) > (100, 50) ORDER BY doc_id, start LIMIT 25""",
)
def keyset_page(spark, sf_dir):
    found = reports.long_spans(main_spans(spark, sf_dir), ["doc_id"])
    rows = found.select("doc_id", "start", "label", "text")
    return reports.page(rows, ["doc_id", "start"], after=(100, 50), size=25)


_IP_NEW = "concat_ws('.', " + ", ".join(
    f"CAST({int_sql(f'Ip{i}', 254, 'value')} + 1 AS VARCHAR)" for i in range(4)
) + ")"
_MAP_POLICY = Policy(
    config={"EMAIL_ADDRESS": "Off", "IP_ADDRESS": "Synthesis"}, seed=SEED
)


@query(
    "A5_entity_mappings",
    resolved_sql()
    + f""", s AS (SELECT *, CASE label WHEN 'EMAIL_ADDRESS' THEN 'Off' WHEN 'IP_ADDRESS' THEN 'Synthesis' ELSE 'Redaction' END AS state FROM resolved),
      m AS (SELECT doc_id, label, value, start, state,
        CASE WHEN state = 'Redaction' THEN {token_sql('label', 'value')} END AS redacted_text,
        CASE WHEN state = 'Synthesis' THEN {_IP_NEW} END AS synthetic_text FROM s)
      SELECT d.doc_id, m.label, m.value AS text, m.redacted_text, m.synthetic_text, m.state AS applied_state,
        coalesce(m.redacted_text, m.synthetic_text, m.value) AS output_text, m.start
      FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""",
)
def entity_mappings(spark, sf_dir):
    """Files without entities stay in the report."""
    rows = reports.mappings(
        main_spans(spark, sf_dir), _MAP_POLICY, ["doc_id"], keep_empty=True
    )
    return rows.drop("row_number", "column_index", "score")


@query(
    "A6_distinct_texts",
    _BY_SOURCE
    + " SELECT source, label, count(DISTINCT value) AS n_texts, min(value) AS first_text FROM resolved GROUP BY ALL",
)
def distinct_texts(spark, sf_dir):
    found = reports.long_spans(main_spans(spark, sf_dir), ["source"])
    unique = found.select("source", "label", "text").distinct()
    return unique.groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n_texts"), F.min("text").alias("first_text")
    )


@query(
    "A6_first_seen",
    _BY_SOURCE
    + """ , f AS (SELECT source, label, value, min(doc_id * 1048576 + start) AS pos FROM resolved GROUP BY ALL)
        SELECT source, label, row_number() OVER (PARTITION BY source, label ORDER BY pos) - 1 AS position,
          value AS text FROM f""",
)
def first_seen(spark, sf_dir):
    """Distinct texts of each label in the order in which a source's documents show them."""
    spans = main_spans(spark, sf_dir).select("doc_id", "source", reports.exploded("spans").alias("s"))
    found = spans.select(
        "source",
        F.col("s.label").alias("label"),
        F.col("s.text").alias("text"),
        (F.col("doc_id") * 1048576 + F.col("s.start")).alias("at"),
    )
    return reports.first_seen(found, ["source"], "at")


@query(
    "A8_file_sizes",
    resolved_sql()
    + r""", w AS (SELECT doc_id, sum(len(regexp_extract_all(value, '[^ \t\r\n\f\x0B]+'))) AS n FROM resolved GROUP BY doc_id)
      SELECT d.doc_id, len(regexp_extract_all(d.text, '[^ \t\r\n\f\x0B]+')) AS words,
        CAST(coalesce(w.n, 0) AS BIGINT) AS redacted_words, strlen(d.text) AS bytes,
        base64(unhex(md5(d.text))) AS hash
      FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id""",
)
def file_sizes(spark, sf_dir):
    return reports.file_sizes(main_spans(spark, sf_dir), "doc_id")


# --- quality --------------------------------------------------------------------------

#: Addresses of eight groups.
_IPV6 = {"IPV6": ("[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}", STANDALONE, 0.9)}
_GOLD_LABELS = ["CREDIT_CARD", "EMAIL_ADDRESS", "NUMERIC_VALUE"]
# gold: resolved spans of three labels; predicted: all candidates of four labels
_PAIR = (
    resolved_sql(_GOLD_LABELS, keys="doc_id, source")
    + f""", gold AS (SELECT DISTINCT doc_id, source, start, stop FROM resolved),
    predicted AS (SELECT DISTINCT doc_id, source, start, stop FROM (
      {candidates_sql(['CREDIT_CARD', 'IP_ADDRESS', 'NUMERIC_VALUE', 'PHONE_NUMBER'], _IPV6, keys='doc_id, source')})),
    pairs AS (SELECT coalesce(p.source, g.source) AS source, p.doc_id IS NOT NULL AS p, g.doc_id IS NOT NULL AS g
      FROM predicted p FULL OUTER JOIN gold g
        ON p.doc_id = g.doc_id AND p.start = g.start AND p.stop = g.stop)"""
)


def _gold_and_predicted(spark, sf_dir):
    gold = reports.long_spans(
        main_spans(spark, sf_dir, _GOLD_LABELS), ["doc_id", "source"]
    )
    wide = with_spans(
        documents(spark, sf_dir),
        builtin(["CREDIT_CARD", "IP_ADDRESS", "NUMERIC_VALUE", "PHONE_NUMBER"]),
        overlaps=True,
    )
    return reports.long_spans(wide, ["doc_id", "source"]), gold


@query(
    "A9_quality_overall",
    _PAIR
    + """ SELECT CAST(sum(CASE WHEN p AND g THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN p AND NOT g THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN g AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        round(sum(CASE WHEN p AND g THEN 1 ELSE 0 END) / sum(CASE WHEN p THEN 1 ELSE 0 END), 6) AS precision,
        round(sum(CASE WHEN p AND g THEN 1 ELSE 0 END) / sum(CASE WHEN g THEN 1 ELSE 0 END), 6) AS recall,
        round(2 * sum(CASE WHEN p AND g THEN 1 ELSE 0 END) / (sum(CASE WHEN p THEN 1 ELSE 0 END) + sum(CASE WHEN g THEN 1 ELSE 0 END)), 6) AS f1,
        CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) AS BIGINT) AS entity_count FROM pairs""",
)
def quality_overall(spark, sf_dir):
    predicted, gold = _gold_and_predicted(spark, sf_dir)
    return _rounded(quality.scores(predicted, gold, ["doc_id"]))


def _rounded(df):
    for name in ("precision", "recall", "f1"):
        df = df.withColumn(name, F.round(name, 6))
    return df


@query(
    "A9_quality_per_file",
    _PAIR
    + """ SELECT source, CAST(sum(CASE WHEN p AND g THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN p AND NOT g THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN g AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) AS BIGINT) AS entity_count FROM pairs GROUP BY source""",
)
def quality_per_file(spark, sf_dir):
    predicted, gold = _gold_and_predicted(spark, sf_dir)
    found = quality.scores(predicted, gold, ["doc_id", "source"], by=["source"])
    return found.select("source", "tp", "fp", "fn", "entity_count")


@query(
    "A9_overlap_recall",
    resolved_sql(_GOLD_LABELS)
    + f""", gold AS (SELECT DISTINCT doc_id, start, stop FROM resolved),
      predicted AS (SELECT * FROM ({candidates_sql(['IP_ADDRESS', 'PHONE_NUMBER', 'CREDIT_CARD'], _IPV6)}))
      SELECT g.doc_id, count(*) AS n_gold, sum(CASE WHEN EXISTS (SELECT 1 FROM predicted p
          WHERE p.doc_id = g.doc_id AND p.start < g.stop AND p.stop > g.start) THEN 1 ELSE 0 END)::BIGINT AS n_hit
      FROM gold g GROUP BY g.doc_id""",
)
def overlap_recall(spark, sf_dir):
    gold = reports.long_spans(main_spans(spark, sf_dir, _GOLD_LABELS), ["doc_id"])
    wide = with_spans(
        documents(spark, sf_dir),
        builtin(["IP_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"]),
        overlaps=True,
    )
    predicted = reports.long_spans(wide, ["doc_id"])
    return quality.overlap_recall(predicted, gold, "doc_id")


@query(
    "A10_best_model",
    """WITH f AS (SELECT d.lang, d.source AS model, round(avg(l.quality), 6) AS f1
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL)
       SELECT lang, model, f1 FROM f
       QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, model) = 1""",
)
def best_model(spark, sf_dir):
    """Sources as models, their mean label quality as score; best per language."""
    scored = (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .groupBy("lang", F.col("source").alias("model"))
        .agg(F.round(F.avg("quality"), 6).alias("f1"))
    )
    return quality.best(scored, "model", "f1", ["lang"])


@query(
    "F11_latest_version",
    """SELECT source, CAST(max(doc_id) AS VARCHAR) AS latest_version FROM documents GROUP BY source""",
)
def latest_version(spark, sf_dir):
    """Document ids as version names: "10" comes after "9"."""
    df = table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").cast("string").alias("version")
    )
    return quality.latest_version(df, "version", ["source"])


# --- manifests ------------------------------------------------------------------------

_STATUS = "CASE lang WHEN 'en' THEN 'Completed' WHEN 'fr' THEN 'Queued' WHEN 'de' THEN 'Running' ELSE 'Failed' END"


def _files(spark, sf_dir):
    """Documents as files: dataset = language, name = source/id, status by language."""
    df = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset"),
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("file_name"),
        "text",
        F.expr(_STATUS).alias("status"),
        F.expr("CAST(n_chars % 7 AS INT)").alias("n_columns"),
    )
    return manifest.with_content_hash(df).drop("text")


_FILES = f"""files AS (SELECT lang AS dataset, doc_id AS file_id,
    source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS file_name, sha256(text) AS content_hash,
    {_STATUS} AS status, CAST(n_chars % 7 AS INT) AS n_columns FROM documents)"""


@query(
    "S9_added_files",
    f"""WITH {_FILES}, held AS (SELECT dataset, content_hash FROM files WHERE status = 'Queued')
        SELECT dataset, content_hash, min(file_name) AS file_name FROM files f
        WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.dataset = f.dataset AND h.content_hash = f.content_hash)
        GROUP BY dataset, content_hash""",
)
def added_files(spark, sf_dir):
    """All files offered to datasets that already hold the queued ones."""
    files = _files(spark, sf_dir)
    return manifest.added_files(files, manifest.by_status(files, "Queued"))


@query(
    "S9_rejected_files",
    f"""WITH {_FILES}, held AS (SELECT dataset, content_hash FROM files WHERE status = 'Queued'),
        kept AS (SELECT dataset, content_hash, min(file_name) AS file_name FROM files f
          WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.dataset = f.dataset AND h.content_hash = f.content_hash)
          GROUP BY dataset, content_hash)
        SELECT dataset, file_name FROM files f WHERE NOT EXISTS (SELECT 1 FROM kept k
          WHERE k.dataset = f.dataset AND k.content_hash = f.content_hash AND k.file_name = f.file_name)""",
)
def rejected_files(spark, sf_dir):
    files = _files(spark, sf_dir)
    held = manifest.by_status(files, "Queued")
    return manifest.rejected_files(files, held).select("dataset", "file_name")


@query(
    "S10_deleted_files",
    f"""WITH {_FILES} SELECT file_id, false AS unknown FROM files
        WHERE file_id NOT IN (SELECT l.doc_id FROM labels l WHERE toxic = 1)
        UNION ALL SELECT doc_id + 1000000000, true FROM labels""",
)
def deleted_files(spark, sf_dir):
    """Toxic documents deleted; ids that do not exist are reported."""
    files = _files(spark, sf_dir)
    marked = table(spark, sf_dir, "labels")
    toxic = marked.where("toxic = 1").select(F.col("doc_id").alias("file_id"))
    missing = marked.select((F.col("doc_id") + 1_000_000_000).alias("file_id"))
    kept = manifest.deleted_files(files, toxic).select("file_id", F.lit(False).alias("unknown"))
    unknown = manifest.unknown_files(files, missing).select("file_id", F.lit(True).alias("unknown"))
    return kept.unionByName(unknown)


def _cells(spark, sf_dir):
    """Customers as rows of CSV files, one file per nation."""
    values = F.expr(
        "CASE WHEN c_nationkey % 3 = 0 THEN array(c_name, c_mktsegment, c_mktsegment || '!')"
        " ELSE array(c_name, c_mktsegment) END"
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("file_id"),
        F.col("c_custkey").alias("row_idx"),
        values.alias("values"),
    )


def _nation_files(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("file_id"),
        F.expr("CASE WHEN n_nationkey % 3 = 0 THEN 3 ELSE 2 END").alias("n_columns"),
        F.expr("CASE WHEN n_regionkey = 1 THEN 'Running' ELSE 'Completed' END").alias("status"),
    )


@query(
    "S11_fetch_all",
    """SELECT c_nationkey AS file_id, c_custkey AS row_idx, c_name AS col0, c_mktsegment AS col1,
         CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment || '!' END AS col2
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1""",
)
def fetch_all(spark, sf_dir):
    return manifest.fetch_all(_cells(spark, sf_dir), _nation_files(spark, sf_dir))


@query(
    "S12_fetch_json",
    """SELECT c_nationkey AS file_id, c_custkey AS row_idx,
         '["' || c_name || '","' || c_mktsegment || CASE WHEN c_nationkey % 3 = 0 THEN '","' || c_mktsegment || '!"]' ELSE '"]' END AS json
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1""",
)
def fetch_json(spark, sf_dir):
    return manifest.as_json(_cells(spark, sf_dir), _nation_files(spark, sf_dir))


@query(
    "S13_file_redaction",
    f"""WITH w AS (SELECT doc_id, text, regexp_extract(text, '^[^ ]+') AS v FROM documents)
        SELECT doc_id, CASE WHEN v = '' THEN text ELSE {token_sql("'PERSON'", 'v')} || substr(text, length(v) + 1) END AS redacted_text FROM w""",
)
def file_redaction(spark, sf_dir):
    """A file's result is that of its text under the same seed."""
    df = documents(spark, sf_dir).withColumn("w", F.expr("regexp_extract(text, '^[^ ]+', 0)"))
    spans = F.expr(
        "filter(array(named_struct('start', 0, 'end', length(w), 'label', 'PERSON',"
        " 'text', w, 'score', 0.9D)), x -> x.end > 0)"
    )
    done = redact_known(df.withColumn("spans", spans), Policy(seed=SEED), key="doc_id")
    return done.select("doc_id", "redacted_text")


@query(
    "S14_visible_datasets",
    "SELECT r_regionkey, r_name FROM region WHERE r_name LIKE 'A%'",
)
def visible_datasets(spark, sf_dir):
    """Regions as datasets; those named A... grant the right to view their settings."""
    df = table(spark, sf_dir, "region").withColumn(
        "operations",
        F.when(F.col("r_name").startswith("A"), F.array(F.lit("Edit"), F.lit("ViewSettings"))).otherwise(
            F.array(F.lit("Edit"))
        ),
    )
    return manifest.visible(df).select("r_regionkey", "r_name")


@query(
    "S15_duplicate_names",
    "SELECT source AS name, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1",
)
def duplicate_names(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("source").alias("name"))
    return manifest.duplicate_names(df)


_REVIEW = "CASE quality WHEN 1 THEN 'Reviewed' ELSE CASE toxic WHEN 1 THEN 'Draft' ELSE 'ReadyForReview' END END"


@query(
    "S16_scorable_files",
    f"SELECT doc_id, {_REVIEW} AS status FROM labels WHERE {_REVIEW} <> 'Draft'",
)
def scorable_files(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", F.expr(_REVIEW).alias("status"))
    return manifest.scorable(df)


@query(
    "F9_files_by_status",
    f"WITH {_FILES} SELECT status, count(*) AS n, min(file_id) AS first_file FROM files GROUP BY status",
)
def files_by_status(spark, sf_dir):
    every = manifest.by_status(_files(spark, sf_dir), "Completed", "Queued", "Running", "Failed")
    return every.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min("file_id").alias("first_file")
    )


@query(
    "A7_dataset_summary",
    f"""WITH {_FILES} SELECT dataset, status, count(*) AS n_files, max(n_columns) AS num_columns
        FROM files GROUP BY ALL""",
)
def dataset_summary(spark, sf_dir):
    return manifest.summary(_files(spark, sf_dir))


@query(
    "A7_open_files",
    f"""WITH {_FILES} SELECT dataset, CASE WHEN status = 'Failed' THEN 'failed' ELSE 'waiting' END AS kind,
          file_id, file_name FROM files WHERE status IN ('Queued', 'Running', 'Failed')""",
)
def open_files(spark, sf_dir):
    """The files of a dataset's summary that wait or failed, by id and name."""
    return manifest.open_files(_files(spark, sf_dir))


# --- policy tables --------------------------------------------------------------------


def _policies(spark, sf_dir):
    """One row per (source, language) with a state and options."""
    return (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("dataset"), F.col("lang").alias("label"))
        .agg(F.min("doc_id").alias("m"))
        .select(
            "dataset",
            "label",
            F.expr("CASE WHEN m % 2 = 0 THEN 'Off' ELSE 'Redaction' END").alias("state"),
            F.concat(F.lit("o"), "m").alias("options"),
            F.array().cast("array<string>").alias("allow"),
            F.array().cast("array<string>").alias("block"),
        )
    )


_POLICIES = """p AS (SELECT source AS dataset, lang AS label,
    CASE WHEN min(doc_id) % 2 = 0 THEN 'Off' ELSE 'Redaction' END AS state, 'o' || min(doc_id) AS options
    FROM documents GROUP BY ALL)"""


@query(
    "C2_copy_settings",
    f"""WITH {_POLICIES} SELECT * FROM p WHERE dataset <> 'src1'
        UNION ALL SELECT 'src1', label, state, options FROM p WHERE dataset = 'src0'""",
)
def copy_settings(spark, sf_dir):
    copied = policies.copied(_policies(spark, sf_dir), "src0", "src1")
    return copied.select("dataset", "label", "state", "options")


@query(
    "C3_partial_edit",
    f"""WITH {_POLICIES} SELECT dataset, label, CASE WHEN label = 'fr' THEN 'Synthesis' ELSE state END AS state,
          CASE WHEN label = 'de' THEN 'new' ELSE options END AS options FROM p""",
)
def partial_edit(spark, sf_dir):
    """French states and German options change; what is null in the edit stays."""
    rows = _policies(spark, sf_dir)
    none = F.lit(None).cast("array<string>")
    changes = rows.where(F.col("label").isin("fr", "de")).select(
        "dataset",
        "label",
        F.expr("CASE WHEN label = 'fr' THEN 'Synthesis' END").alias("state"),
        F.expr("CASE WHEN label = 'de' THEN 'new' END").alias("options"),
        none.alias("allow"),
        none.alias("block"),
    )
    return policies.edited(rows, changes).select("dataset", "label", "state", "options")


@query(
    "C4_enabled_entities",
    f"""WITH {_POLICIES} SELECT dataset, label FROM p WHERE NOT (dataset = 'src2' AND label = 'en')
        UNION SELECT 'src3', 'custom'""",
)
def enabled_entities(spark, sf_dir):
    rows = _policies(spark, sf_dir).select("dataset", "label")
    on = policies.enabled(policies.enabled(rows, "src3", "custom"), "src3", "custom")
    return policies.disabled(on, "src2", "en")


@query(
    "C5_request_log",
    """SELECT event_id, sha256(event_type) AS input_hash, 'page' || event_type AS result,
              CASE WHEN event_type = 'click' THEN 'web' ELSE 'api' END AS tag
       FROM events WHERE ts + to_hours(CASE WHEN event_type = 'click' THEN 48 ELSE 24 END)
             > TIMESTAMP '2024-01-05 00:00:00'""",
)
def log(spark, sf_dir):
    """All events logged under their id, clicks kept 48 hours and others 24, then purged at
    a given time."""
    rows = table(spark, sf_dir, "events").withColumn(
        "redacted_text", F.concat(F.lit("page"), "event_type")
    )
    click = F.col("event_type") == "click"
    at, keys = F.col("ts"), ["event_id"]
    logged = request_log.records(rows.where(click), at, 48, ["web"], "event_type", keys).unionByName(
        request_log.records(rows.where(~click), at, 24, ["api"], "event_type", keys)
    )
    kept = request_log.purged(logged, F.expr("TIMESTAMP '2024-01-05 00:00:00'"))
    tagged = [request_log.with_tag(kept, t).withColumn("tag", F.lit(t)) for t in ("web", "api")]
    return tagged[0].unionByName(tagged[1]).select("event_id", "input_hash", "result", "tag")


@query(
    "C6_rescan",
    f"""WITH {_FILES} SELECT dataset, count(*) AS n FROM files WHERE status <> 'Completed' GROUP BY dataset""",
)
def rescan(spark, sf_dir):
    """Completed files were made under the current policy, the others were not."""
    current = manifest.policy_hash(json.dumps({"default": "Redaction", "config": {}}))
    files = _files(spark, sf_dir).withColumn(
        "policy_hash",
        F.when(F.col("status") == "Completed", F.lit(current)).when(
            F.col("status") == "Queued", F.lit("old")
        ),
    )
    return manifest.to_rescan(files, current).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
