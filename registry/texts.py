"""Markup, JSON, parsed documents, conversations, transcripts and chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilframe.functions.sql import col, fn
from veilframe.operators import conversation, json_text, markup, reports, transcript
from veilframe.operators.chunking import chunks, split_markdown
from veilframe.operators.detect import rules, with_spans
from veilframe.policy import Policy
from veilframe.session import checkpoint_dir, spread
from veilframe.sources import parsed
from veilframe.streaming import conversations

from .common import (
    SEED,
    documents,
    main_spans,
    matches,
    query,
    quoted,
    resolved_sql,
    table,
    token_sql,
)

_NUMBERS = Policy(
    default="Off", config={"NUMERIC_VALUE": "Redaction"}, seed=SEED, claim_off=False
)
_NUM_TOKEN = "'NUMERIC_VALUE'"

#: Small documents made of table rows: rows of a task.
_TASK_ROWS = 100_000
#: Rows of a file of a stream: its micro-batches are cut in a task per file or a few.
_STREAM_ROWS = 2_000

# --- JSON -----------------------------------------------------------------------------

_NESTED = (
    """'{"order": {"key": ' || o_orderkey || ', "tags": ["' || o_orderstatus || '", {"p": "' """
    """|| o_orderpriority || '"}]}, "none": null, "ok": true}'"""
)


@query(
    "T1_json_leaves",
    """SELECT o_orderkey, '$.order.key' AS path, 'number' AS kind, CAST(o_orderkey AS VARCHAR) AS value FROM orders
       UNION ALL SELECT o_orderkey, '$.order.tags[0]', 'string', o_orderstatus FROM orders
       UNION ALL SELECT o_orderkey, '$.order.tags[1].p', 'string', o_orderpriority FROM orders
       UNION ALL SELECT o_orderkey, '$.none', 'null', NULL FROM orders
       UNION ALL SELECT o_orderkey, '$.ok', 'boolean', 'true' FROM orders""",
)
def json_leaves(spark, sf_dir):
    df = spread(table(spark, sf_dir, "orders"), "o_orderkey", task_rows=_TASK_ROWS).select(
        "o_orderkey", F.expr(_NESTED).alias("json")
    )
    return json_text.explode_leaves(df, "json", "o_orderkey")


@query(
    "T1_redact_json",
    f"""SELECT event_id, '{{"k": "' || {token_sql(_NUM_TOKEN, "json_extract_string(props, '$.k')")} || '"}}' AS redacted_text
        FROM events""",
)
def redact_json(spark, sf_dir):
    df = spread(table(spark, sf_dir, "events"), "event_id", task_rows=_TASK_ROWS).select("event_id", "props")
    done = json_text.redact_json(df, _NUMBERS, "props", "event_id")
    return done.select("event_id", "redacted_text")


_ORDER_LABEL = token_sql("'ORGANIZATION'", "o_orderstatus")
_ORDER_DAY = token_sql("'DATE_TIME'", "CAST(o_orderkey AS VARCHAR)")


@query(
    "T2_json_path_allow",
    f"""SELECT o_orderkey, '{{"order": {{"key": "' || {_ORDER_DAY} || '", "tags": ["' || {_ORDER_LABEL}
          || '", {{"p": "' || o_orderpriority || '"}}]}}, "none": null, "ok": true}}' AS redacted_text FROM orders""",
)
def json_path_allow(spark, sf_dir):
    """Path rules give whole values a label; the smallest of several labels wins."""
    df = spread(table(spark, sf_dir, "orders"), "o_orderkey", task_rows=_TASK_ROWS).select(
        "o_orderkey", F.expr(_NESTED).alias("json")
    )
    policy = Policy(
        default="Off",
        config={"ORGANIZATION": "Redaction", "DATE_TIME": "Redaction"},
        path_allow={
            "ORGANIZATION": ["$.order.tags[0]", "$.order.key"],
            "DATE_TIME": ["$.order.key"],
        },
        seed=SEED,
        claim_off=False,
    )
    return json_text.redact_json(df, policy, "json", "o_orderkey").select(
        "o_orderkey", "redacted_text"
    )


@query(
    "T3_json_ignore_paths",
    f"""SELECT o_orderkey, '{{"order": {{"key": ' || o_orderkey || ', "tags": ["' || o_orderstatus
          || '", {{"p": "' || {token_sql(_NUM_TOKEN, "substr(o_orderpriority, 1, 1)")} || substr(o_orderpriority, 2)
          || '"}}]}}, "none": null, "ok": true}}' AS redacted_text FROM orders""",
)
def json_ignore_paths(spark, sf_dir):
    from dataclasses import replace

    df = spread(table(spark, sf_dir, "orders"), "o_orderkey", task_rows=_TASK_ROWS).select(
        "o_orderkey", F.expr(_NESTED).alias("json")
    )
    policy = replace(_NUMBERS, path_ignore=["$..key"])
    return json_text.redact_json(df, policy, "json", "o_orderkey").select(
        "o_orderkey", "redacted_text"
    )


@query(
    "T4_json_span_paths",
    """SELECT event_id, 'NUMERIC_VALUE' AS label, json_extract_string(props, '$.k') AS text,
         '$.k' AS path, 0 AS start FROM events""",
)
def json_span_paths(spark, sf_dir):
    df = spread(table(spark, sf_dir, "events"), "event_id", task_rows=_TASK_ROWS).select("event_id", "props")
    done = json_text.redact_json(df, _NUMBERS, "props", "event_id")
    return done.select("event_id", reports.exploded("spans").alias("s")).select(
        "event_id", "s.label", "s.text", "s.path", "s.start"
    )


# --- markup ---------------------------------------------------------------------------

_XML = (
    "'<?xml version=\"1.0\"?><c:rec xmlns:c=\"urn:99\"><!-- 5 --><c:id n=\"' || c_custkey || '\"/>"
    "<name>' || c_name || '</name><name k=\"x\">' || c_mktsegment || ' ' || c_nationkey || ' B</name></c:rec>'"
)


def _customers(spark, sf_dir):
    return spread(table(spark, sf_dir, "customer"), "c_custkey", task_rows=_TASK_ROWS)


@query(
    "T5_redact_xml",
    f"""SELECT c_custkey, '<?xml version="1.0"?><c:rec xmlns:c="urn:99"><!-- 5 --><c:id n="'
        || {token_sql(_NUM_TOKEN, 'CAST(c_custkey AS VARCHAR)')} || '"/><name>Customer#'
        || {token_sql(_NUM_TOKEN, "split_part(c_name, '#', 2)")} || '</name><name k="x">' || c_mktsegment || ' '
        || {token_sql(_NUM_TOKEN, 'CAST(c_nationkey AS VARCHAR)')} || ' B</name></c:rec>' AS redacted_text FROM customer""",
)
def redact_xml(spark, sf_dir):
    df = _customers(spark, sf_dir).select("c_custkey", F.expr(_XML).alias("xml"))
    done = markup.redact_markup(df, _NUMBERS, "xml", "c_custkey", html=False)
    return done.select("c_custkey", "redacted_text")


@query(
    "T5_xml_paths",
    """SELECT c_custkey, '/c:rec[1]/c:id[1]/@n' AS path, CAST(c_custkey AS VARCHAR) AS text, 0 AS start FROM customer
       UNION ALL SELECT c_custkey, '/c:rec[1]/name[1]', split_part(c_name, '#', 2), 9 FROM customer
       UNION ALL SELECT c_custkey, '/c:rec[1]/name[2]', CAST(c_nationkey AS VARCHAR), length(c_mktsegment) + 1 FROM customer""",
)
def xml_paths(spark, sf_dir):
    df = _customers(spark, sf_dir).select("c_custkey", F.expr(_XML).alias("xml"))
    done = markup.redact_markup(df, _NUMBERS, "xml", "c_custkey", html=False)
    return done.select("c_custkey", reports.exploded("spans").alias("s")).select(
        "c_custkey", "s.path", "s.text", "s.start"
    )


_HTML_CUT = f"{markup._HIDDEN_HTML}|{markup._TAG}"
# RE2 has no possessive forms; on these pages the greedy ones match the same
_HTML_RE2 = (
    f"{markup._HIDDEN_HTML}|"
    r"(?s:</?[A-Za-z_:](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>)"
)


@query(
    "T6_html_text",
    f"""SELECT page_id, len(regexp_extract_all(html, {quoted(_HTML_RE2)})) AS n_markup,
          CAST(list_sum(list_transform(string_split_regex(html, {quoted(_HTML_RE2)}), lambda x: length(x))) AS BIGINT) AS text_chars,
          md5(array_to_string(string_split_regex(html, {quoted(_HTML_RE2)}), '')) AS text_md5
        FROM pages""",
)
def html_text(spark, sf_dir):
    """Markup and visible text of a page, told apart."""
    pieces = markup._pieces(markup.mark_safe(col("html")), _HTML_CUT)
    pages = spread(table(spark, sf_dir, "pages"), "page_id").select(
        "page_id", pieces.column().alias("p")
    )
    texts = fn.filter(col("p"), lambda x, i: i % 2 == 0)
    listed = pages.withColumn("t", fn.array_join(texts, "").column())
    return listed.select(
        "page_id",
        F.expr("CAST((size(p) - 1) / 2 AS INT)").alias("n_markup"),
        F.length("t").alias("text_chars"),
        F.md5("t").alias("text_md5"),
    )


_HTML_LABELS = ["CREDIT_CARD", "EMAIL_ADDRESS", "IP_ADDRESS"]


def _html_done(spark, sf_dir):
    policy = Policy(
        default="Off",
        config={label: "Redaction" for label in _HTML_LABELS},
        seed=SEED,
        claim_off=False,
    )
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return markup.redact_markup(pages, policy, "html", "page_id")


@query(
    "T6_html_entities",
    resolved_sql(_HTML_LABELS, source="pages", keys="page_id", text="html")
    + " SELECT page_id, label, value AS text, count(*) AS n FROM resolved GROUP BY ALL",
)
def html_entities(spark, sf_dir):
    found = _html_done(spark, sf_dir).select("page_id", reports.exploded("spans").alias("s"))
    return found.groupBy(
        "page_id", F.col("s.label").alias("label"), F.col("s.text").alias("text")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "T6_redact_html",
    resolved_sql(_HTML_LABELS, source="pages", keys="page_id", text="html")
    + f""", pieces AS (SELECT page_id, start, stop,
        substr(text, coalesce(lag(stop) OVER (PARTITION BY page_id ORDER BY start), 0) + 1,
               start - coalesce(lag(stop) OVER (PARTITION BY page_id ORDER BY start), 0))
          || {token_sql('label', 'value')} AS piece FROM resolved),
      built AS (SELECT page_id, string_agg(piece, '' ORDER BY start) AS head, max(stop) AS last_stop FROM pieces GROUP BY page_id)
      SELECT p.page_id, md5(coalesce(b.head || substr(p.html, b.last_stop + 1), p.html)) AS md5
      FROM pages p LEFT JOIN built b USING (page_id)""",
)
def redact_html(spark, sf_dir):
    return _html_done(spark, sf_dir).select("page_id", F.md5("redacted_text").alias("md5"))


@query(
    "T6_straddling_and_attributes",
    f"""SELECT c_custkey, '<p title="x">Dear ' || {token_sql("'NRP'", "c_name")} || '<b></b>, <a href="mailto:'
          || {token_sql("'EMAIL_ADDRESS'", "lower(c_mktsegment) || c_custkey || '@mail.example'")}
          || '">write</a></p>' AS redacted_text FROM customer""",
)
def straddling(spark, sf_dir):
    """Names that inline tags cut in three, and addresses in attributes."""
    html = (
        "'<p title=\"x\">Dear ' || substr(c_name, 1, 5) || '<b>' || substr(c_name, 6, 6) || '</b>'"
        " || substr(c_name, 12) || ', <a href=\"mailto:' || lower(c_mktsegment) || c_custkey"
        " || '@mail.example\">write</a></p>'"
    )
    policy = Policy(
        default="Off",
        config={"NRP": "Redaction", "EMAIL_ADDRESS": "Redaction"},
        allow={"NRP": ["Customer#[0-9]+"]},
        seed=SEED,
        claim_off=False,
    )
    pages = _customers(spark, sf_dir).select("c_custkey", F.expr(html).alias("html"))
    done = markup.redact_markup(pages, policy, "html", "c_custkey")
    return done.select("c_custkey", "redacted_text")


# --- parsed documents -----------------------------------------------------------------


def _parsed(spark, sf_dir):
    """Parsed documents derived from customers (sheets) and suppliers (pages)."""
    sheets = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("doc_id"),
        F.expr(
            """'{"fileType":"Csv","schemaVersion":1,"content":{"text":"' || c_name || '","hash":"h","entities":['
            || '{"start":0,"end":8,"label":"NRP","text":"Customer","score":0.9},'
            || '{"start":9,"end":18,"label":"NUMERIC_VALUE","text":"' || substring(c_name, 10) || '","score":0.7}]},'
            || '"tables":[{"tableName":"t","header":["name","segment"],"data":[[{"text":"' || c_name
            || '","hash":"x","entities":[]},null],[{"text":"","hash":"y","entities":[]},{"text":"' || c_mktsegment
            || '","hash":"z","entities":[]}]]}],"footNotes":[{"text":"note ' || c_nationkey || '","hash":"n","entities":[]}]}'"""
        ).alias("json"),
    )
    pages = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("doc_id"),
        F.expr(
            """'{"fileType":"Pdf","schemaVersion":1,"content":{"text":"# ' || s_name || '","hash":"h","entities":[]},'
            || '"kvps":[{"key":"nation","value":"' || s_nationkey || '"}],'
            || '"pages":[[{"type":"Title","content":{"text":"' || s_name || '","hash":"p","entities":[]}}]],'
            || '"tables":[[[{"type":"ColumnHeader","content":{"text":"a","hash":"1","entities":[]}},null,'
            || '{"type":"Content","content":{"text":"b","hash":"2","entities":[]}}],'
            || '[{"type":"Content","content":{"text":"' || s_nationkey || '","hash":"3","entities":[]}}]]],'
            || '"header":{"First":{"text":"top","hash":"t","entities":[]}},'
            || '"senderAddress":{"address":"' || s_suppkey || '@x.com"},"toAddresses":[{"address":"to@x.com","displayName":"T"}]}'"""
        ).alias("json"),
    )
    both = sheets.unionByName(pages)
    return both.select(
        "doc_id", F.from_json("json", parsed.DOCUMENT).alias("d")
    ).select("doc_id", "d.*")


@query(
    "T7_cells",
    """SELECT 'c' || c_custkey AS doc_id, 't' AS table_name, 0 AS "row", 0 AS col, 'name' AS header, c_name AS text, 'x' AS hash FROM customer
       UNION ALL SELECT 'c' || c_custkey, 't', 0, 1, 'segment', '', '1B2M2Y8AsgTpgAmY7PhCfg==' FROM customer
       UNION ALL SELECT 'c' || c_custkey, 't', 1, 0, 'name', '', 'y' FROM customer
       UNION ALL SELECT 'c' || c_custkey, 't', 1, 1, 'segment', c_mktsegment, 'z' FROM customer
       UNION ALL SELECT 's' || s_suppkey, 'table_0', 0, 0, 'a', 'a', '1' FROM supplier
       UNION ALL SELECT 's' || s_suppkey, 'table_0', 0, 1, '', '', '1B2M2Y8AsgTpgAmY7PhCfg==' FROM supplier
       UNION ALL SELECT 's' || s_suppkey, 'table_0', 0, 2, NULL, 'b', '2' FROM supplier
       UNION ALL SELECT 's' || s_suppkey, 'table_0', 1, 0, 'a', CAST(s_nationkey AS VARCHAR), '3' FROM supplier""",
)
def cells(spark, sf_dir):
    return parsed.cells(_parsed(spark, sf_dir)).select(
        "doc_id", "table_name", "row", "col", "header", "text", "hash"
    )


@query(
    "T8_cell_lookup",
    """SELECT 'c' || c_custkey AS doc_id, c_mktsegment AS text FROM customer""",
)
def cell_lookup(spark, sf_dir):
    return parsed.cell(_parsed(spark, sf_dir), 1, 1, "t").select("doc_id", "text")


@query(
    "T9_parts",
    """SELECT 'c' || c_custkey AS doc_id, 'footnote' AS part, NULL AS kind, 'note ' || c_nationkey AS text FROM customer
       UNION ALL SELECT 's' || s_suppkey, 'page', 'Title', s_name FROM supplier
       UNION ALL SELECT 's' || s_suppkey, 'header', 'First', 'top' FROM supplier
       UNION ALL SELECT 's' || s_suppkey, 'sender', NULL, s_suppkey || '@x.com' FROM supplier
       UNION ALL SELECT 's' || s_suppkey, 'to', NULL, 'to@x.com' FROM supplier""",
)
def document_parts(spark, sf_dir):
    docs = _parsed(spark, sf_dir)
    mail = parsed.addresses(docs).select(
        "doc_id",
        F.col("role").alias("part"),
        F.lit(None).cast("string").alias("kind"),
        F.col("address").alias("text"),
    )
    return parsed.parts(docs).select("doc_id", "part", "kind", "text").unionByName(mail)


@query(
    "T10_markdown",
    f"""SELECT 'c' || c_custkey AS doc_id, {token_sql("'NRP'", "'Customer'")} || '#' || split_part(c_name, '#', 2) AS redacted_text, 'Csv' AS file_type FROM customer
        UNION ALL SELECT 's' || s_suppkey, '# ' || s_name, 'Pdf' FROM supplier""",
)
def document_markdown(spark, sf_dir):
    """Renderings redacted with their own entities; other labels stay (default Off)."""
    from veilframe.operators.redact import redact_known

    docs = _parsed(spark, sf_dir)
    policy = Policy(default="Off", config={"NRP": "Redaction"}, seed=SEED)
    done = redact_known(parsed.markdown(docs.select("doc_id", "content", "fileType")), policy)
    kinds = docs.select("doc_id", F.col("fileType").alias("file_type"))
    return done.join(kinds, "doc_id").select("doc_id", "redacted_text", "file_type")


@query(
    "T11_key_values",
    "SELECT 's' || s_suppkey AS doc_id, 'nation' AS key, CAST(s_nationkey AS VARCHAR) AS value FROM supplier",
)
def key_values(spark, sf_dir):
    return parsed.key_values(_parsed(spark, sf_dir))


@query(
    "S5_document_entities",
    """SELECT 'c' || c_custkey AS doc_id, 0 AS start, 8 AS "end", 'NRP' AS label, 'Customer' AS text FROM customer
       UNION ALL SELECT 'c' || c_custkey, 9, 18, 'NUMERIC_VALUE', split_part(c_name, '#', 2) FROM customer""",
)
def document_entities(spark, sf_dir):
    return parsed.entities(_parsed(spark, sf_dir)).drop("score")


# --- chunks ---------------------------------------------------------------------------

_LIMIT = 400
_CHUNKS = f"""cut AS (
  SELECT doc_id, text, 0 AS chunk_no, 0 AS start,
    CASE WHEN {_LIMIT} >= length(text) THEN length(text)
         WHEN position(chr(10) IN reverse(substr(text, 1, {_LIMIT}))) > 0
              AND {_LIMIT} - position(chr(10) IN reverse(substr(text, 1, {_LIMIT}))) > 0
           THEN {_LIMIT} - position(chr(10) IN reverse(substr(text, 1, {_LIMIT})))
         ELSE {_LIMIT} END AS stop
  FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, chunk_no + 1, nxt,
    CASE WHEN nxt + {_LIMIT} >= length(text) THEN length(text)
         WHEN position(chr(10) IN reverse(substr(text, nxt + 1, {_LIMIT}))) > 0
              AND {_LIMIT} - position(chr(10) IN reverse(substr(text, nxt + 1, {_LIMIT}))) > 0
           THEN nxt + {_LIMIT} - position(chr(10) IN reverse(substr(text, nxt + 1, {_LIMIT})))
         ELSE nxt + {_LIMIT} END
  FROM (SELECT *, CASE WHEN substr(text, stop + 1, 1) = chr(10)
                        AND position(chr(10) IN substr(text, start + 1, {_LIMIT})) > 0
                        AND stop < start + {_LIMIT}
                   THEN stop + 1 ELSE stop END AS nxt FROM cut)
  WHERE nxt < length(text))"""


@query(
    "G7_split_markdown",
    f"""WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_no, start, stop AS "end" FROM cut""",
)
def split(spark, sf_dir):
    cut = split_markdown(documents(spark, sf_dir), "text", _LIMIT)
    return cut.select(
        "doc_id",
        F.posexplode(F.expr("filter(sections, x -> true)")).alias("chunk_no", "c"),
    ).select("doc_id", "chunk_no", "c.start", "c.end")


@query(
    "G7_split_by_headers",
    """WITH l AS (SELECT conv_id, turn, role, text, length('# ' || role || ' ' || turn) + 1 + length(text) + 1 AS n FROM conversations),
       o AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS stop FROM l)
       SELECT conv_id, stop - n AS start, stop AS "end", role || ' ' || turn AS header FROM o""",
)
def split_by_headers(spark, sf_dir):
    """Conversations written as Markdown, one first-level header per turn."""
    turns = table(spark, sf_dir, "conversations")
    rendered = turns.withColumn(
        "text", F.expr("'# ' || role || ' ' || turn || '\\n' || text || '\\n'")
    )
    whole = conversation.joined_context(rendered, ["conv_id"], "turn", separator="")
    cut = split_markdown(whole, "text", 1_000_000)
    return cut.select(
        "conv_id", F.explode(F.expr("filter(sections, x -> true)")).alias("c")
    ).select("conv_id", "c.start", "c.end", F.expr("c.headers[0]").alias("header"))


@query(
    "G8_chunks",
    resolved_sql()
    + f""", {_CHUNKS},
    j AS (SELECT c.doc_id, c.chunk_no, c.start, c.stop, r.label, r.value, r.start AS at
          FROM cut c LEFT JOIN resolved r ON c.doc_id = r.doc_id
            AND r.start <= c.stop AND r.stop >= c.start)
    SELECT doc_id, chunk_no, start, stop AS "end",
      coalesce(bool_or(label = 'EMAIL_ADDRESS'), false) AS is_sensitive,
      count(DISTINCT CASE WHEN label IN ('CREDIT_CARD', 'IP_ADDRESS') THEN label || value END) AS n_texts,
      coalesce(string_agg(DISTINCT CASE WHEN label = 'CREDIT_CARD' THEN value END, ','
        ORDER BY CASE WHEN label = 'CREDIT_CARD' THEN value END), '') AS cards
    FROM j GROUP BY doc_id, chunk_no, start, stop""",
)
def document_chunks(spark, sf_dir):
    policy = Policy(default="Off", config={"EMAIL_ADDRESS": "Redaction"})
    found = chunks(
        main_spans(spark, sf_dir),
        policy,
        max_chars=_LIMIT,
        metadata_labels=["CREDIT_CARD", "IP_ADDRESS"],
    )
    return found.select(
        "doc_id",
        "chunk_no",
        "start",
        "end",
        "is_sensitive",
        F.size(F.flatten(F.map_values("entities"))).alias("n_texts"),
        F.coalesce(
            F.array_join(F.array_sort(F.try_element_at("entities", F.lit("CREDIT_CARD"))), ","),
            F.lit(""),
        ).alias("cards"),
    )


# --- conversations --------------------------------------------------------------------

_TALK = {"NRP": [r"(?:de|der|the|la) [a-z]+"], "EVENT": [r"[a-z]+tion"]}
_TALK_POLICY = Policy(
    default="Off",
    config={"NRP": "Redaction", "EVENT": "Redaction"},
    allow=_TALK,
    seed=SEED,
    claim_off=False,
)
_TURN_CANDIDATES = " UNION ALL ".join(
    f"""SELECT conv_id, turn, text, '{label}' AS label, CAST(0.95 AS DOUBLE) AS score, value,
          start, start + length(value) AS stop
        FROM ({matches(regexes[0], 'conversations', 'conv_id, turn')})"""
    for label, regexes in _TALK.items()
)
_TURNS = resolved_sql(keys="conv_id, turn", candidates=_TURN_CANDIDATES)


@query(
    "G1_join_rows",
    """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
)
def join_rows(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    return conversation.joined_context(df, ["conv_id"], "turn").select(
        "conv_id", "text"
    )


@query(
    "G2_line_offsets",
    """SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start,
         CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS line_end FROM conversations""",
)
def line_offsets(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    return conversation.with_line_offsets(df, ["conv_id"], "turn").select(
        "conv_id", "turn", "line_start", "line_end"
    )


@query(
    "W1_running_offset_one_group",
    """SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (ORDER BY conv_id, turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM conversations""",
)
def one_group_offsets(spark, sf_dir):
    """All rows in one group: the sums are cut into blocks, not one window."""
    df = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", (F.col("conv_id") * 64 + F.col("turn")).alias("ord")
    )
    return conversation.with_line_offsets(
        df.withColumn("g", F.lit("constant")), ["g"], "ord", bits=6
    ).select("conv_id", "turn", "line_start")


@query(
    "G3_redact_rows",
    _TURNS
    + f""", pieces AS (SELECT conv_id, turn, start, stop,
        substr(text, coalesce(lag(stop) OVER (PARTITION BY conv_id, turn ORDER BY start), 0) + 1,
               start - coalesce(lag(stop) OVER (PARTITION BY conv_id, turn ORDER BY start), 0))
          || {token_sql('label', 'value')} AS piece FROM resolved),
      built AS (SELECT conv_id, turn, string_agg(piece, '' ORDER BY start) AS head, max(stop) AS last_stop,
          count(*) AS n FROM pieces GROUP BY conv_id, turn)
      SELECT c.conv_id, c.turn, coalesce(b.head || substr(c.text, b.last_stop + 1), c.text) AS redacted_text,
        coalesce(b.n, 0) AS n, -1 AS usage,
        length(coalesce(b.head || substr(c.text, b.last_stop + 1), c.text)) - length(c.text) AS longer
      FROM conversations c LEFT JOIN built b USING (conv_id, turn)""",
)
def redact_rows(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    rows = conversation.redact_rows(df, _TALK_POLICY, ["conv_id"], "turn")
    return rows.select(
        "conv_id",
        "turn",
        "redacted_text",
        fn.size(col("spans")).column().alias("n"),
        "usage",
        conversation.length_difference(col("spans")).column().alias("longer"),
    )


@query(
    "G3_rows_of_one_group",
    _TURNS
    + """ SELECT conv_id, turn, start, stop AS "end", label, value AS text FROM resolved""",
)
def rows_of_one_group(spark, sf_dir):
    """All turns as one group, whose patterns cannot cross a row."""
    df = table(spark, sf_dir, "conversations").select(
        F.lit("constant").alias("g"), (F.col("conv_id") * 64 + F.col("turn")).alias("ord"), "text"
    )
    rows = conversation.redact_rows(df, _TALK_POLICY, ["g"], "ord")
    return rows.select("ord", reports.exploded("spans").alias("s")).select(
        F.floor(F.col("ord") / 64).alias("conv_id"),
        (F.col("ord") % 64).alias("turn"),
        "s.start",
        "s.end",
        "s.label",
        "s.text",
    )


_BORDER = r"[A-Za-zÀ-ÿ]+[.]\n[A-ZÀ-Þ][a-zà-ÿ]+"


@query(
    "G3_border_entities",
    f"""WITH j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
        o AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS n FROM conversations),
        e AS (SELECT conv_id, start, start + length(value) AS stop, value FROM ({matches(_BORDER, 'j', 'conv_id')}))
        SELECT o.conv_id, o.turn, CAST(greatest(e.start - o.a, 0) AS BIGINT) AS start,
          CAST(least(e.stop, o.a + o.n) - o.a AS BIGINT) AS "end", e.value AS text
        FROM e JOIN o ON e.conv_id = o.conv_id AND e.start < o.a + o.n AND e.stop > o.a""",
)
def border_entities(spark, sf_dir):
    """Entities that end in a later row are clipped to each row they touch."""
    policy = Policy(
        default="Off", config={"LAW": "Redaction"}, allow={"LAW": [_BORDER]}, claim_off=False
    )
    df = table(spark, sf_dir, "conversations")
    rows = conversation.redact_rows(df, policy, ["conv_id"], "turn")
    return rows.select("conv_id", "turn", reports.exploded("spans").alias("s")).select(
        "conv_id", "turn", "s.start", "s.end", "s.text"
    )


@query(
    "G3_border_entities_one_group",
    f"""WITH t AS (SELECT conv_id * 64 + turn AS ord, text FROM conversations),
        j AS (SELECT 1 AS grp, string_agg(text, chr(10) ORDER BY ord) AS text FROM t),
        o AS (SELECT ord, coalesce(sum(length(text) + 1) OVER (ORDER BY ord
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS n, text FROM t),
        e AS (SELECT start, start + length(value) AS stop, value FROM ({matches(_BORDER, 'j', 'grp')}))
        SELECT o.ord, CAST(greatest(e.start - o.a, 0) AS BIGINT) AS start,
          CAST(least(e.stop, o.a + o.n) - o.a AS BIGINT) AS "end", e.value AS text,
          {token_sql("'LAW'", 'e.value')} AS new_text
        FROM e JOIN o ON e.start < o.a + o.n AND e.stop > o.a""",
)
def border_entities_one_group(spark, sf_dir):
    """All turns as one group, with a pattern that crosses rows: only ends of rows meet."""
    policy = Policy(
        default="Off",
        config={"LAW": "Redaction"},
        allow={"LAW": [_BORDER]},
        claim_off=False,
        seed=SEED,
    )
    df = table(spark, sf_dir, "conversations").select(
        F.lit("constant").alias("g"), (F.col("conv_id") * 64 + F.col("turn")).alias("ord"), "text"
    )
    rows = conversation.redact_rows(df, policy, ["g"], "ord")
    return rows.select("ord", reports.exploded("spans").alias("s")).select(
        "ord", "s.start", "s.end", "s.text", "s.new_text"
    )


@query(
    "G1_stream_conversations",
    f"""WITH j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
        o AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS n, text FROM conversations),
        e AS (SELECT conv_id, start, start + length(value) AS stop, value FROM ({matches(_BORDER, 'j', 'conv_id')})),
        h AS (SELECT o.conv_id, o.turn, o.text, greatest(e.start - o.a, 0) AS start,
                least(e.stop, o.a + o.n) - o.a AS stop, {token_sql("'LAW'", 'e.value')} AS new_text
              FROM e JOIN o ON e.conv_id = o.conv_id AND e.start < o.a + o.n AND e.stop > o.a),
        p AS (SELECT conv_id, turn, start, stop, substr(text, CAST(coalesce(lag(stop) OVER w, 0) + 1 AS BIGINT),
                CAST(start - coalesce(lag(stop) OVER w, 0) AS BIGINT)) || new_text AS piece
              FROM h WINDOW w AS (PARTITION BY conv_id, turn ORDER BY start)),
        b AS (SELECT conv_id, turn, string_agg(piece, '' ORDER BY start) AS head, max(stop) AS stop, count(*) AS n
              FROM p GROUP BY ALL)
        SELECT c.conv_id, c.turn, coalesce(b.head || substr(c.text, CAST(b.stop + 1 AS BIGINT)), c.text) AS redacted_text,
          coalesce(b.n, 0) AS n_spans, CAST(length(c.text) AS BIGINT) AS n_chars
        FROM conversations c LEFT JOIN b USING (conv_id, turn)""",
)
def stream_conversations(spark, sf_dir):
    """The turns as a stream in four shuffled micro-batches, redacted with the context of
    their conversation; entities may cross turns."""
    policy = Policy(
        default="Off", config={"LAW": "Redaction"}, allow={"LAW": [_BORDER]}, claim_off=False, seed=SEED
    )
    folder = f"{checkpoint_dir(spark).rstrip('/')}/veilframe-stream-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "text",
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, turn)").alias("ts"),
    )
    # files hold their number of rows: no column is read
    files = max(1, -(-turns.count() // (4 * _STREAM_ROWS)))
    turns.repartition(4 * files, F.xxhash64("turn", "conv_id")).write.parquet(f"{folder}/in")
    # counted, as the session may deal the rows to more files than asked for
    files = max(1, -(-len(spark.read.parquet(f"{folder}/in").inputFiles()) // 4))
    # a row that moves the watermark beyond all others closes the conversations
    spark.sql(
        "SELECT CAST(null AS bigint) AS conv_id, 0L AS turn, '' AS text, timestamp'2025-01-01' AS ts"
    ).write.mode("append").parquet(f"{folder}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    conversations.use_state_store(spark)
    try:
        source = (
            spark.readStream.schema(turns.schema)
            .option("maxFilesPerTrigger", files)
            .parquet(f"{folder}/in")
            .withWatermark("ts", "1 day")
        )
        pieces = conversations.redact_conversations(source, policy, ["conv_id"], "turn", "ts", "1 hour")
        query = (
            pieces.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    stored = spark.read.parquet(f"{folder}/out").where("conv_id IS NOT NULL AND NOT late")
    return conversations.assembled(stored, ["conv_id"], "turn").select(
        "conv_id", "turn", "redacted_text", F.size("spans").alias("n_spans"), "n_chars"
    )


_FORTY_ROWS = r"(?:[^\n]*\n){40}[^\n]*"


@query(
    "G3_entities_over_forty_rows",
    f"""WITH t AS (SELECT conv_id // 64 AS grp, conv_id * 64 + turn AS ord, text FROM conversations),
        j AS (SELECT grp, string_agg(text, chr(10) ORDER BY ord) AS text FROM t GROUP BY grp),
        o AS (SELECT grp, ord, coalesce(sum(length(text) + 1) OVER (PARTITION BY grp ORDER BY ord
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS n FROM t),
        e AS (SELECT grp, start, start + length(value) AS stop, value FROM ({matches(_FORTY_ROWS, 'j', 'grp')}))
        SELECT o.ord, CAST(greatest(e.start - o.a, 0) AS BIGINT) AS start,
          CAST(least(e.stop, o.a + o.n) - o.a AS BIGINT) AS "end", sha256(e.value) AS text_hash
        FROM e JOIN o ON e.grp = o.grp AND e.start < o.a + o.n AND e.stop > o.a""",
)
def entities_over_forty_rows(spark, sf_dir):
    """Entities of 41 rows, in groups of some hundred turns."""
    policy = Policy(
        default="Off", config={"LAW": "Redaction"}, allow={"LAW": [_FORTY_ROWS]}, claim_off=False
    )
    df = table(spark, sf_dir, "conversations").select(
        F.expr("conv_id div 64").alias("grp"), F.expr("conv_id * 64 + turn").alias("ord"), "text"
    )
    rows = conversation.redact_rows(df, policy, ["grp"], "ord")
    return rows.select("ord", reports.exploded("spans").alias("s")).select(
        "ord", "s.start", "s.end", F.sha2("s.text", 256).alias("text_hash")
    )


@query(
    "G5_json_conversation",
    """SELECT conv_id, turn, role, text FROM conversations""",
)
def json_conversation(spark, sf_dir):
    """Conversation documents taken apart into ordered items."""
    docs = (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("items"))
        .select(
            "conv_id",
            F.to_json(
                F.struct(F.struct(F.col("items").alias("transcript")).alias("conversation"))
            ).alias("json"),
        )
    )
    kind = "conversation struct<transcript:array<struct<role:string,text:string>>>"
    return conversation.items(
        docs.withColumn("d", F.from_json("json", kind)),
        "conv_id",
        "d.conversation.transcript",
        "text",
        role="role",
    )


# --- transcripts ----------------------------------------------------------------------


def _transcripts(spark, sf_dir):
    """Conversations as transcripts: a word per 100 ms, a segment per turn, and the last
    word of a segment repeated at the start of the next one."""
    grouped = (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    )
    # position of a turn's first word among all words
    words = fn.transform(col("t"), lambda x: fn.split(x["text"], " ", -1))
    counted = grouped.withColumn("w", words.column()).withColumn(
        "at",
        F.expr(
            "transform(sequence(0, size(w) - 1), i ->"
            " aggregate(slice(w, 1, i), 0, (a, x) -> a + size(x)))"
        ),
    )
    segments = F.expr(
        """transform(w, (ws, i) -> named_struct('start', CAST(at[i] * 100 AS DOUBLE),
             'end', CAST((at[i] + size(ws)) * 100 AS DOUBLE), 'id', i, 'text', t[i].text,
             'words', concat(
               CASE WHEN i = 0 THEN array() ELSE array(named_struct(
                 'start', CAST((at[i] - 1) * 100 AS DOUBLE), 'end', CAST(at[i] * 100 AS DOUBLE),
                 'word', element_at(w[i - 1], -1))) END,
               transform(ws, (x, k) -> named_struct('start', CAST((at[i] + k) * 100 AS DOUBLE),
                 'end', CAST((at[i] + k + 1) * 100 AS DOUBLE), 'word', x)))))"""
    )
    return counted.select(
        F.col("conv_id").alias("doc_id"),
        F.array_join(F.expr("transform(t, x -> x.text)"), " ").alias("text"),
        segments.alias("segments"),
    )


_WORDS = """j AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
  ws AS (SELECT doc_id, string_split(text, ' ') AS w FROM j),
  wi AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM ws),
  wo AS (SELECT doc_id, i - 1 AS pos, w[i] AS word,
           CAST(coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS a
         FROM wi),
  words AS (SELECT doc_id, pos, word, a AS char_start, a + length(word) AS char_end FROM wo)"""


@query(
    "G9_word_alignment",
    f"WITH {_WORDS} SELECT doc_id, pos, word, char_start, char_end FROM words",
)
def word_alignment(spark, sf_dir):
    """Words found in the text, border repeats dropped (G10)."""
    aligned = transcript.with_aligned_words(_transcripts(spark, sf_dir))
    return aligned.select("doc_id", F.posexplode(F.expr("filter(words, x -> true)")).alias("pos", "w")).select(
        "doc_id", "pos", "w.word", "w.char_start", "w.char_end"
    )


_SPOKEN = r"(?:de|der|the|la) [a-z]+"


@query(
    "G11_intervals",
    f"""WITH {_WORDS},
      e AS (SELECT doc_id, i - 1 AS span, start, start + length(value) AS stop FROM ({matches(_SPOKEN, 'j')}))
      SELECT e.doc_id, e.span, CAST(min(pos) * 100 AS DOUBLE) AS start, CAST((max(pos) + 1) * 100 AS DOUBLE) AS "end"
      FROM e JOIN words w ON e.doc_id = w.doc_id AND w.char_start < e.stop AND w.char_end > e.start
      GROUP BY e.doc_id, e.span""",
)
def intervals(spark, sf_dir):
    return _intervals(spark, sf_dir)


def _spoken(spark, sf_dir):
    """Transcripts with spans and aligned words."""
    found = with_spans(_transcripts(spark, sf_dir), rules({"NRP": [_SPOKEN]}))
    return transcript.with_aligned_words(found)


def _intervals(spark, sf_dir):
    return transcript.intervals(_spoken(spark, sf_dir))


@query(
    "G12_mute_list",
    f"""WITH {_WORDS},
      e AS (SELECT doc_id, i - 1 AS span, start, start + length(value) AS stop FROM ({matches(_SPOKEN, 'j')})),
      t AS (SELECT e.doc_id, e.span, greatest(min(pos) * 100 - 250, 0) AS s, least((max(pos) + 1) * 100 + 250, 60000) AS f
            FROM e JOIN words w ON e.doc_id = w.doc_id AND w.char_start < e.stop AND w.char_end > e.start
            GROUP BY e.doc_id, e.span),
      g AS (SELECT *, CASE WHEN s <= max(f) OVER (PARTITION BY doc_id ORDER BY s, f
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM t),
      n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, f) AS island FROM g)
      SELECT doc_id, CAST(min(s) AS DOUBLE) AS start, CAST(max(f) AS DOUBLE) AS "end" FROM n GROUP BY doc_id, island""",
)
def mute_list(spark, sf_dir):
    """Padded by 250 ms, kept within one minute, overlapping intervals merged."""
    found = _spoken(spark, sf_dir).withColumn("duration", F.lit(60000.0))
    return transcript.mute_list(found, "duration")


@query(
    "G6_redact_transcript",
    _TURNS
    + """ SELECT conv_id AS doc_id, turn AS segment, start, stop AS "end", label, value AS text FROM resolved""",
)
def redact_transcript(spark, sf_dir):
    done = transcript.redact_transcripts(_transcripts(spark, sf_dir), _TALK_POLICY)
    return done.select("doc_id", "segment", reports.exploded("spans").alias("s")).select(
        "doc_id", "segment", "s.start", "s.end", "s.label", "s.text"
    )


@query(
    "G6_transcript_text",
    _TURNS
    + f""", pieces AS (SELECT conv_id, turn, start, stop,
        substr(text, coalesce(lag(stop) OVER (PARTITION BY conv_id, turn ORDER BY start), 0) + 1,
               start - coalesce(lag(stop) OVER (PARTITION BY conv_id, turn ORDER BY start), 0))
          || {token_sql('label', 'value')} AS piece FROM resolved),
      built AS (SELECT conv_id, turn, string_agg(piece, '' ORDER BY start) AS head, max(stop) AS last_stop
          FROM pieces GROUP BY conv_id, turn)
      SELECT c.conv_id AS doc_id, string_agg(coalesce(b.head || substr(c.text, b.last_stop + 1), c.text), chr(10) ORDER BY c.turn) AS redacted_text
      FROM conversations c LEFT JOIN built b USING (conv_id, turn) GROUP BY c.conv_id""",
)
def transcript_text(spark, sf_dir):
    done = transcript.redact_transcripts(_transcripts(spark, sf_dir), _TALK_POLICY)
    return transcript.redacted_text(done).select("doc_id", "redacted_text")
