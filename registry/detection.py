"""Detection queries (pattern, dictionary and rule spans) and policy filters."""

from __future__ import annotations

from pyspark.sql import functions as F


from veilframe.functions.spans import Pattern, utf16_spans
from veilframe.functions.sql import col, fn
from veilframe.operators import chunking, policies, quality, reports
from veilframe.operators.detect import (
    aba_valid,
    builtin,
    iban_valid,
    known_entities,
    luhn_valid,
    rules,
    whole_value,
    with_spans,
)
from veilframe.operators.gazetteer import gazetteer_hits
from veilframe.policy import Policy
from veilframe.session import spread

from .common import (
    GIVEN_RULES,
    MAIN,
    RULES,
    SECRET,
    candidates_sql,
    documents,
    given_spans,
    main_spans,
    matches,
    query,
    quoted,
    resolved_sql,
    secret_pattern,
    table,
)


def _one_label(label: str):
    def run(spark, sf_dir):
        found = with_spans(documents(spark, sf_dir), builtin([label]), language="lang")
        return reports.long_spans(found, ["doc_id"]).select(
            "doc_id", "start", "end", "label", "text"
        )

    regex, accept, _ = RULES[label]
    sql = f"""SELECT doc_id, start, start + length(value) AS "end", '{label}' AS label,
                     value AS text FROM ({matches(regex)}) WHERE {accept}"""
    return run, sql


for _label, _name in [
    ("EMAIL_ADDRESS", "email"),
    ("PHONE_NUMBER", "phone"),
    ("IP_ADDRESS", "ip"),
    ("CREDIT_CARD", "card"),
    ("NUMERIC_VALUE", "number"),
]:
    _run, _sql = _one_label(_label)
    query(f"D1_detect_{_name}", _sql)(_run)


@query("D1_detect_all")
def detect_all(spark, sf_dir):
    """Every built-in detector at once, per label and language."""
    found = with_spans(documents(spark, sf_dir), builtin(), language="lang")
    return found.select(reports.exploded("spans").alias("s")).groupBy(
        F.col("s.label").alias("label"), F.col("s.language").alias("language")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("s.start").alias("sum_start"))


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"


@query(
    "D2_checksums",
    f"""WITH c AS (SELECT doc_id, start, {_DIGITS} AS d FROM ({matches(RULES['CREDIT_CARD'][0])})
          WHERE {RULES['CREDIT_CARD'][1]}),
        e AS (SELECT *, substr(d, 1, 9) AS r,
                'GB' || substr(d, 1, 2) || 'WEST' || substr(d, 3) AS b FROM c)
        SELECT doc_id, start,
          list_sum(list_transform(range(1, length(d) + 1), lambda i:
            CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, CAST(i AS BIGINT), 1) AS INTEGER)
                 WHEN CAST(substr(d, CAST(i AS BIGINT), 1) AS INTEGER) > 4
                   THEN CAST(substr(d, CAST(i AS BIGINT), 1) AS INTEGER) * 2 - 9
                 ELSE CAST(substr(d, CAST(i AS BIGINT), 1) AS INTEGER) * 2 END)) % 10 = 0 AS luhn,
          (3 * (CAST(substr(r,1,1) AS INT) + CAST(substr(r,4,1) AS INT) + CAST(substr(r,7,1) AS INT))
           + 7 * (CAST(substr(r,2,1) AS INT) + CAST(substr(r,5,1) AS INT) + CAST(substr(r,8,1) AS INT))
           + CAST(substr(r,3,1) AS INT) + CAST(substr(r,6,1) AS INT) + CAST(substr(r,9,1) AS INT)) % 10 = 0
            AS aba,
          CAST(array_to_string(list_transform(
             range(1, length(substr(b,5) || substr(b,1,4)) + 1), lambda i:
               CASE WHEN regexp_matches(substr(substr(b,5) || substr(b,1,4), CAST(i AS BIGINT), 1), '[0-9]')
                    THEN substr(substr(b,5) || substr(b,1,4), CAST(i AS BIGINT), 1)
                    ELSE CAST(ascii(substr(substr(b,5) || substr(b,1,4), CAST(i AS BIGINT), 1)) - 55 AS VARCHAR)
               END), '') AS HUGEINT) % 97 = 1 AS iban
        FROM e""",
)
def checksums(spark, sf_dir):
    found = with_spans(documents(spark, sf_dir), builtin(["CREDIT_CARD"]))
    cards = reports.long_spans(found, ["doc_id"]).withColumn(
        "d", F.regexp_replace("text", "[^0-9]", "")
    )
    values = cards.select(
        "doc_id",
        "start",
        "d",
        F.substring("d", 1, 9).alias("r"),
        F.expr("'GB' || substring(d, 1, 2) || 'WEST' || substring(d, 3)").alias("b"),
    )
    return values.select(
        "doc_id",
        "start",
        luhn_valid(col("d")).column().alias("luhn"),
        aba_valid(col("r")).column().alias("aba"),
        iban_valid(col("b")).column().alias("iban"),
    )


_WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


@query(
    "D3_gazetteer",
    f"""WITH gaz AS (SELECT DISTINCT lower(regexp_extract(text, {quoted('^([^ ]+) ([^ ]+)')}, 1)) AS a,
               lower(regexp_extract(text, {quoted('^([^ ]+) ([^ ]+)')}, 2)) AS b FROM benchmark),
        key2 AS (SELECT DISTINCT array_to_string(regexp_extract_all(a || ' ' || b, {quoted(_WORD)}), ' ') AS k FROM gaz),
        key1 AS (SELECT DISTINCT array_to_string(regexp_extract_all(a, {quoted(_WORD)}), ' ') AS k FROM gaz),
        keys AS (SELECT 'LAW' AS label, k FROM key2 WHERE k <> '' UNION
                 SELECT 'EVENT', k FROM key1 WHERE k <> ''),
        w AS (SELECT doc_id, i, start, start + length(value) AS stop, lower(value) AS value
              FROM ({matches(_WORD)})),
        runs AS (SELECT doc_id, start, stop, value AS k FROM w
                 UNION ALL
                 SELECT a.doc_id, a.start, b.stop, a.value || ' ' || b.value
                 FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1)
        SELECT r.doc_id, k.label, r.start, r.stop AS "end" FROM runs r JOIN keys k ON r.k = k.k""",
)
def gazetteer(spark, sf_dir):
    heads = F.expr(r"regexp_extract(text, '^([^ ]+) ([^ ]+)', 0)")
    bench = table(spark, sf_dir, "benchmark")
    gaz = bench.select(F.lit("LAW").alias("label"), heads.alias("term")).unionByName(
        bench.select(
            F.lit("EVENT").alias("label"), F.split("text", " ")[0].alias("term")
        )
    )
    return gazetteer_hits(documents(spark, sf_dir), gaz).select(
        "doc_id", "label", "start", "end"
    )


@query(
    "D3_gazetteer_passages",
    f"""WITH terms AS (SELECT DISTINCT list_transform(regexp_extract_all(text, {quoted(_WORD)}), lambda x: lower(x)) AS t FROM benchmark),
        w AS (SELECT doc_id, i, start, start + length(value) AS stop, lower(value) AS value
              FROM ({matches(_WORD)})),
        d AS (SELECT doc_id, list(value ORDER BY i) AS words, list(stop ORDER BY i) AS stops FROM w GROUP BY doc_id),
        n AS (SELECT doc_id, start, value, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w)
        SELECT n.doc_id, 'LAW' AS label, n.start, d.stops[n.k + len(t.t) - 1] AS "end"
        FROM n JOIN terms t ON t.t[1] = n.value JOIN d ON d.doc_id = n.doc_id
        WHERE d.words[n.k : n.k + len(t.t) - 1] = t.t""",
)
def gazetteer_passages(spark, sf_dir):
    """Terms of dozens of words: passages as entities."""
    gaz = table(spark, sf_dir, "benchmark").select(F.lit("LAW").alias("label"), F.col("text").alias("term"))
    return gazetteer_hits(documents(spark, sf_dir), gaz).select(
        "doc_id", "label", "start", "end"
    )


_ALLOW = {"PRODUCT": [r"[Tt]hnt[a-z]*"], "NRP": [r"erlich|enlich[a-z]+", r"elle[a-z]+"]}
_BLOCK = {"PRODUCT": [r"Thnt[a-z]+ of"], "NRP": [r"elle[a-z]+[.]"]}


def _rule_candidates(lists: dict) -> str:
    return " UNION ALL ".join(
        f"""SELECT doc_id, text, '{label}' AS label, CAST(0.95 AS DOUBLE) AS score, value,
             start, start + length(value) AS stop FROM ({matches(regex)})"""
        for label, regexes in lists.items()
        for regex in regexes
    )


@query(
    "D4_allow_list",
    resolved_sql(candidates=_rule_candidates(_ALLOW))
    + ' SELECT doc_id, start, stop AS "end", label, value AS text FROM resolved',
)
def allow_list(spark, sf_dir):
    found = with_spans(documents(spark, sf_dir), rules(_ALLOW))
    return reports.long_spans(found, ["doc_id"]).drop("score")


@query(
    "D5_block_list",
    resolved_sql(
        candidates=f"""SELECT c.* FROM ({_rule_candidates(_ALLOW)}) c
          WHERE NOT EXISTS (SELECT 1 FROM ({_rule_candidates(_BLOCK)}) b
            WHERE b.doc_id = c.doc_id AND b.label = c.label
              AND b.start <= c.start AND b.stop >= c.stop)"""
    )
    + ' SELECT doc_id, start, stop AS "end", label, value AS text FROM resolved',
)
def block_list(spark, sf_dir):
    found = with_spans(documents(spark, sf_dir), rules(_ALLOW), block=_BLOCK)
    return reports.long_spans(found, ["doc_id"]).drop("score")


@query(
    "D6_custom_secret",
    f"""SELECT doc_id, start, start + length(value) AS "end", value AS text
        FROM ({matches(SECRET)})""",
)
def custom_secret(spark, sf_dir):
    found = with_spans(documents(spark, sf_dir), [secret_pattern()])
    return reports.long_spans(found, ["doc_id"]).select("doc_id", "start", "end", "text")


@query(
    "D7_whole_value",
    """SELECT c_custkey, 0 AS start, length(c_name) AS "end", 'PERSON' AS label, c_name AS text
       FROM customer WHERE c_name <> ''""",
)
def structured_value(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    spans = df.select("c_custkey", whole_value(col("c_name"), "PERSON").column().alias("spans"))
    return reports.long_spans(spans, ["c_custkey"]).drop("score")


@query(
    "D8_resolve_overlaps",
    resolved_sql()
    + ' SELECT doc_id, start, stop AS "end", label, value AS text FROM resolved',
)
def resolve_overlaps(spark, sf_dir):
    return reports.long_spans(main_spans(spark, sf_dir), ["doc_id"]).drop("score")


@query(
    "D9_known_entities",
    resolved_sql(
        candidates="""SELECT doc_id, text, 'A' AS label, 0.5 AS score, substr(text, 1, 9) AS value,
              0 AS start, 9 AS stop FROM documents WHERE length(text) >= 9
            UNION ALL SELECT doc_id, text, 'B', 0.9, substr(text, 6, 15), 5, 20
              FROM documents WHERE length(text) >= 20
            UNION ALL SELECT doc_id, text, 'C', 0.9, substr(text, 10, 30), 9, 39
              FROM documents WHERE length(text) >= 39"""
    )
    + ' SELECT doc_id, start, stop AS "end", label, value AS text FROM resolved',
)
def known(spark, sf_dir):
    df = documents(spark, sf_dir).withColumn(
        "given",
        F.expr(
            "transform(array(named_struct('s', 0, 'e', 9, 'l', 'A', 'p', 0.5D),"
            " named_struct('s', 5, 'e', 20, 'l', 'B', 'p', 0.9D),"
            " named_struct('s', 9, 'e', 39, 'l', 'C', 'p', 0.9D)), x -> named_struct("
            "'start', x.s, 'end', x.e, 'label', x.l, 'text', '', 'score', x.p))"
        ),
    )
    text = known_entities(col("text"), col("given"))
    spans = df.withColumn("spans", text.column())
    return spans.select("doc_id", "text", reports.exploded("spans").alias("s")).select(
        "doc_id",
        "s.start",
        "s.end",
        "s.label",
        F.expr("substring(text, s.start + 1, s.end - s.start)").alias("text"),
    )


@query(
    "D9_known_entities_whole",
    resolved_sql(MAIN, GIVEN_RULES)
    + ' SELECT doc_id, start, stop AS "end", label, value AS text FROM resolved',
)
def known_whole(spark, sf_dir):
    """Supplied spans all over the texts, many of them overlapping."""
    df = given_spans(spark, sf_dir)
    kept = df.withColumn("spans", known_entities(col("text"), col("spans")).column())
    return kept.select("doc_id", reports.exploded("spans").alias("s")).select(
        "doc_id", "s.start", "s.end", "s.label", "s.text"
    )


@query(
    "D10_language",
    resolved_sql(keys="doc_id, lang")
    + " SELECT lang AS language, label, count(*) AS n FROM resolved GROUP BY lang, label",
)
def language(spark, sf_dir):
    return (
        main_spans(spark, sf_dir)
        .select(reports.exploded("spans").alias("s"))
        .groupBy(F.col("s.language").alias("language"), F.col("s.label").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "D11_utf16",
    f"""SELECT doc_id, start AS python_start, start + length(value) AS python_end,
          start + length(regexp_replace(substr(text, 1, start), {quoted(chr(0x1F332))}, {quoted(chr(0x1F332) * 2)}, 'g')) - start AS start,
          start + length(value)
            + length(regexp_replace(substr(text, 1, start + length(value)), {quoted(chr(0x1F332))}, {quoted(chr(0x1F332) * 2)}, 'g')) - (start + length(value)) AS "end"
        FROM ({matches('[a-z]+tion', "(SELECT doc_id, replace(text, '. ', '. ' || chr(127794) || ' ') AS text FROM documents)")})""",
)
def utf16(spark, sf_dir):
    """Offsets after supplementary characters (one is put after every sentence)."""
    df = documents(spark, sf_dir).withColumn(
        "text", F.expr(r"replace(text, '. ', '. \U0001F332 ')")
    )
    found = with_spans(df, [Pattern("WORD", "[a-z]+tion", 0.5)])
    listed = found.withColumn("u", utf16_spans(col("text"), col("spans")).column())
    return listed.select("doc_id", reports.exploded("u").alias("u")).select(
        "doc_id", "u.python_start", "u.python_end", "u.start", "u.end"
    )


# --- policy filters -------------------------------------------------------------------

_CONFIG = {
    "EMAIL_ADDRESS": "Off",
    "IP_ADDRESS": "Synthesis",
    "PHONE_NUMBER": "Redaction",
    "NUMERIC_VALUE": "Off",
}
_STATE_SQL = """CASE label WHEN 'EMAIL_ADDRESS' THEN 'Off' WHEN 'IP_ADDRESS' THEN 'Synthesis'
    WHEN 'PHONE_NUMBER' THEN 'Redaction' WHEN 'NUMERIC_VALUE' THEN 'Off' ELSE 'Redaction' END"""


@query(
    "F1_effective_state",
    resolved_sql()
    + f" SELECT label, {_STATE_SQL} AS state, count(*) AS n FROM resolved GROUP BY ALL",
)
def effective_state(spark, sf_dir):
    policy = Policy(config=_CONFIG)
    found = reports.long_spans(main_spans(spark, sf_dir), ["doc_id"])
    return found.groupBy("label", policy.state(col("label")).column().alias("state")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "F1_policy_table_state",
    resolved_sql()
    + f" SELECT doc_id, start, label, {_STATE_SQL} AS state FROM resolved",
)
def policy_table_state(spark, sf_dir):
    """States looked up in a stored policy table."""
    rows = policies.to_rows(spark, "main", Policy(config=_CONFIG))
    found = reports.long_spans(main_spans(spark, sf_dir), ["doc_id"])
    return policies.states(found, rows, "main").select("doc_id", "start", "label", "state")


@query(
    "F2_drop_off",
    resolved_sql()
    + f' SELECT doc_id, start, stop AS "end", label FROM resolved WHERE {_STATE_SQL} <> \'Off\'',
)
def drop_off(spark, sf_dir):
    kept = main_spans(spark, sf_dir).withColumn(
        "spans", Policy(config=_CONFIG).keep(col("spans")).column()
    )
    return reports.long_spans(kept, ["doc_id"]).select("doc_id", "start", "end", "label")


@query(
    "F3_invalid_policy_rows",
    """SELECT source AS dataset, upper(lang) AS label,
         CASE WHEN quality_state IN ('Off','Synthesis','Redaction','GroupingSynthesis','ReplacementSynthesis')
              THEN 'key' ELSE 'key and value' END AS problem
       FROM (SELECT DISTINCT source, lang,
               CASE WHEN lang = 'en' THEN 'Off' ELSE lang END AS quality_state FROM documents)""",
)
def invalid_policy_rows(spark, sf_dir):
    """Rows of a policy table (here: one per source and language) that are not valid."""
    rows = table(spark, sf_dir, "documents").select("source", "lang").distinct().select(
        F.col("source").alias("dataset"),
        F.upper("lang").alias("label"),
        F.expr("CASE WHEN lang = 'en' THEN 'Off' ELSE lang END").alias("state"),
        F.lit(None).cast("string").alias("options"),
        F.array().cast("array<string>").alias("allow"),
        F.array().cast("array<string>").alias("block"),
    )
    problems = policies.invalid_rows(rows).groupBy("dataset", "label").agg(
        F.array_sort(F.collect_set("code")).alias("codes")
    )
    column = F.transform("codes", lambda c: F.when(c == "label", "key").otherwise("value"))
    return problems.select("dataset", "label", F.array_join(column, " and ").alias("problem"))


@query(
    "F4_entities_of_labels",
    resolved_sql()
    + """ SELECT doc_id, label, value AS text FROM resolved
          WHERE label IN ('EMAIL_ADDRESS', 'IP_ADDRESS')""",
)
def entities_of_labels(spark, sf_dir):
    found = reports.long_spans(main_spans(spark, sf_dir), ["doc_id"])
    return found.where(F.col("label").isin("EMAIL_ADDRESS", "IP_ADDRESS")).select(
        "doc_id", "label", "text"
    )


@query(
    "F5_all_entities_overlapping",
    f"""SELECT doc_id, start, stop AS "end", label FROM ({candidates_sql()})""",
)
def all_entities(spark, sf_dir):
    """All candidates, overlaps allowed."""
    found = with_spans(documents(spark, sf_dir), builtin(MAIN), overlaps=True)
    return reports.long_spans(found, ["doc_id"]).select("doc_id", "start", "end", "label")


@query(
    "F8_is_sensitive",
    resolved_sql()
    + """ SELECT d.doc_id,
           coalesce(bool_or(r.label IN ('EMAIL_ADDRESS', 'PHONE_NUMBER')), false) AS anywhere,
           coalesce(bool_or(r.label IN ('EMAIL_ADDRESS', 'PHONE_NUMBER') AND r.start <= 500 AND r.stop >= 100), false) AS in_range,
           coalesce(bool_or(r.label = 'CREDIT_CARD' AND r.stop >= 300), false) AS open_range
         FROM documents d LEFT JOIN resolved r ON d.doc_id = r.doc_id GROUP BY d.doc_id""",
)
def is_sensitive(spark, sf_dir):
    df = main_spans(spark, sf_dir)
    pair = ["EMAIL_ADDRESS", "PHONE_NUMBER"]
    return df.select(
        "doc_id",
        chunking.is_sensitive(col("spans"), pair).column().alias("anywhere"),
        chunking.is_sensitive(col("spans"), pair, 100, 500).column().alias("in_range"),
        chunking.is_sensitive(col("spans"), ["CREDIT_CARD"], 300).column().alias("open_range"),
    )


@query(
    "F10_enabled_labels",
    f"""SELECT label, {_STATE_SQL} AS state, n FROM (
          SELECT label, count(*) AS n FROM ({candidates_sql()}) GROUP BY label)
        WHERE label IN ('EMAIL_ADDRESS','IP_ADDRESS','PHONE_NUMBER','NUMERIC_VALUE')
          AND {_STATE_SQL} <> 'Off'""",
)
def enabled_labels(spark, sf_dir):
    policy = Policy(config=_CONFIG)
    found = with_spans(documents(spark, sf_dir), builtin(MAIN), overlaps=True)
    counted = reports.counts(found.withColumn("f", F.lit(1)), "f")
    return counted.where(F.col("label").isin(policy.enabled_labels())).select(
        "label", policy.state(col("label")).column().alias("state"), "n"
    )


@query(
    "F12_null_texts",
    f"""WITH t AS (SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE text END AS text FROM documents)
        SELECT t.doc_id, t.text IS NULL AS is_null, count(m.value) AS n
        FROM t LEFT JOIN ({matches(RULES['EMAIL_ADDRESS'][0])}) m
          ON t.doc_id = m.doc_id AND t.text IS NOT NULL GROUP BY ALL""",
)
def null_texts(spark, sf_dir):
    """Null texts (here: the German ones) pass through with null spans."""
    df = documents(spark, sf_dir).withColumn(
        "text", F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.col("text"))
    )
    found = with_spans(df, builtin(["EMAIL_ADDRESS"]))
    return found.select(
        "doc_id",
        (F.col("text").isNull() & F.col("spans").isNull()).alias("is_null"),
        F.coalesce(fn.size(col("spans")).column(), F.lit(0)).alias("n"),
    )


# --- every built-in label, on sentences made from supplier keys ------------------------


def _digit(i: int) -> str:
    return f"CAST(substr(lpad(CAST(k * 7919 AS STRING), 8, '0'), {i}, 1) AS BIGINT)"


def _padded(value: str, width: int) -> str:
    return f"lpad(CAST({value} AS STRING), {width}, '0')"


_ABA = "(10 - (3 * ({}+{}+{}) + 7 * ({}+{}+{}) + {}+{}) % 10) % 10".format(
    *[_digit(i) for i in (1, 4, 7, 2, 5, 8, 3, 6)]
)
# WEST is 32 14 28 29 and GB is 16 11 when letters are read as numbers
_IBAN = f"98 - (((32142829 % 97) * 100000000000000 + 10000000000000 + k) % 97 * 1000000 + 161100) % 97"
#: Label, words in front, the value as SQL that both engines read, words behind.
_SENTENCES = [
    ("EMAIL_ADDRESS", "write to ", "'u' || k || '.x@mail' || (k % 7) || '.example.org'", ""),
    ("URL", "see ", "'https://host' || (k % 9) || '.example/p?id=' || k", " there"),
    ("IP_ADDRESS", "from ", "(k % 256) || '.' || (k * 7 % 256) || '.10.' || (k % 100)", " again"),
    ("IP_ADDRESS", "from host ", "'2001:db8:0:0:0:ff:' || (1000 + k % 9000) || ':' || (k % 9)", " again"),
    ("PHONE_NUMBER", "call ", f"'(' || (200 + k % 700) || ') 555-' || {_padded('k % 10000', 4)}", " soon"),
    ("CREDIT_CARD", "card ", f"'4' || {_padded('k', 15)}", " please"),
    ("US_SSN", "ssn ", "(100 + k % 500) || '-' || (10 + k % 80) || '-' || (1000 + k % 9000)", ""),
    ("US_ITIN", "itin ", "'9' || (10 + k % 80) || '-70-' || (1000 + k % 9000)", ""),
    ("IBAN_CODE", "iban ", f"'GB' || {_padded(_IBAN, 2)} || 'WEST' || (10000000000000 + k)", " here"),
    ("MICR_CODE", "line ", f"'\u2446' || {_padded('k', 9)} || '\u2446'", " end"),
    ("MONEY", "due ", f"'$' || (1 + k % 900) || ',' || {_padded('k * 13 % 1000', 3)} || '.50'", " now"),
    ("MONEY", "due: ", f"'9' || {_padded('k', 9)} || ',000 USD'", " now"),
    ("DATE_TIME", "on ", "(1950 + k % 70) || '-0' || (1 + k % 9) || '-1' || (k % 10)", ""),
    ("DOB", "born on ", "'0' || (1 + k % 9) || '/1' || (k % 10) || '/' || (1950 + k % 50)", ""),
    ("PERSON_AGE", "she is ", "CAST(20 + k % 60 AS STRING)", " years old"),
    ("LOCATION_ZIP", "Boise, ID ", "CAST(83700 + k % 90 AS STRING)", ""),
    ("LOCATION_STATE", "lives in Boise, ", "'ID'", " now"),
    ("NUMERIC_PII", "ref ", "'AB' || (100000 + k)", ""),
    ("NUMERIC_VALUE", "this is ", "CAST(k AS STRING)", " of them"),
    ("US_BANK_NUMBER", "account ", "CAST(100000000 + k AS STRING)", " is open"),
    ("US_ROUTING_TRANSIT_NUMBER", "routing number ", f"{_padded('k * 7919', 8)} || ({_ABA})", ""),
    ("CC_EXP", "expires ", "'0' || (1 + k % 9) || '/' || (25 + k % 9)", ""),
    ("CVV", "cvv: ", "CAST(100 + k % 900 AS STRING)", ""),
    ("PASSWORD", "password: ", "'pw' || k || '!x'", " then"),
    ("USERNAME", "username is ", "'user_' || k", " then"),
    ("HEALTHCARE_ID", "MRN ", "CAST(10000000 + k AS STRING)", ""),
    ("US_PASSPORT", "passport number ", "'A' || (10000000 + k)", ""),
    ("MEDICAL_LICENSE", "medical license ", "'AB' || (100000 + k)", ""),
    ("US_DRIVER_LICENSE", "driver license ", "'B' || (100000 + k)", ""),
]
#: A long way between the words that announce a value and the value before it.
_LEAD = "well then " * 30


@query(
    "D1_sentences",
    " UNION ALL ".join(
        f"""SELECT k, {i} AS sentence, {len(_LEAD) + len(front)} AS start,
              {len(_LEAD) + len(front)} + length({value}) AS "end", '{label}' AS label, {value} AS text
            FROM (SELECT s_suppkey AS k FROM supplier)"""
        for i, (label, front, value, _) in enumerate(_SENTENCES)
    ),
)
def sentences(spark, sf_dir):
    """All labels at once on sentences whose values are known by construction."""
    rows = spread(
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", task_rows=2_000
    )
    texts = F.array(
        *[
            F.struct(
                F.lit(i).alias("sentence"),
                F.lit(label).alias("label"),
                F.concat(F.lit(_LEAD + front), F.expr(value), F.lit(behind)).alias("text"),
            )
            for i, (label, front, value, behind) in enumerate(_SENTENCES)
        ]
    )
    made = rows.select("k", F.explode(texts).alias("m")).select("k", "m.*")
    found = with_spans(made.withColumnRenamed("label", "expected"), builtin())
    return found.select("k", "sentence", "expected", reports.exploded("spans").alias("s")).where(
        "s.label = expected"
    ).select("k", "sentence", "s.start", "s.end", "s.label", "s.text")


#: Compressed addresses: words in front, the value as SQL that both engines read, words behind.
_IPV6_SENTENCES = [
    ("from ", "'2001:db8::' || (1 + k % 9000)", " again"),
    ("from [", "'fe80::' || (k % 10) || ':ff:' || (k % 7)", "]:8080"),
    ("node:", "'fe80::' || (1 + k % 90)", "%eth0"),
    ("to ", "'::' || (1 + k % 9000)", ", then"),
    ("net ", "'2001:db8:' || (k % 100) || '::'", "/48"),
    ("mapped ", "'::ffff:192.0.2.' || (k % 200)", "."),
    ("tail ", "'64:ff9b::192.0.2.' || (k % 200)", "."),
    ("all ", "'1:2:3:4:5:6:7:' || (k % 9000)", " of it"),
    ("seven ", "'1:2:3::5:6:7:' || (k % 9000)", ": yes"),
]
#: No addresses: two gaps, five digits, nine groups, times, hardware addresses, code.
_NO_IPV6 = [
    "'at 1::2::' || k",
    "'at 12345::' || (k % 100)",
    "'at 1:2:3:4:5:6:7:8:' || (k % 100)",
    "'at 1:2:3:4::5:6:7:' || (k % 100)",
    "'at 12:30:' || (10 + k % 50)",
    "'at 00:1a:2b:3c:4d:' || (10 + k % 50)",
    "'std::deque and std::add::' || (k % 100)",
]


def _ipv6_found(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    texts = [
        F.concat(F.lit(_LEAD + front), F.expr(value), F.lit(behind))
        for front, value, behind in _IPV6_SENTENCES
    ] + [F.concat(F.lit(_LEAD), F.expr(value)) for value in _NO_IPV6]
    made = rows.select("k", F.posexplode(F.array(*texts)).alias("sentence", "text"))
    return with_spans(made, builtin(["IP_ADDRESS"]))


_IPV6_SQL = " UNION ALL ".join(
    f"""SELECT k, {i} AS sentence, {len(_LEAD) + len(front)} AS start,
          {len(_LEAD) + len(front)} + length({value}) AS "end", {value} AS text
        FROM (SELECT s_suppkey AS k FROM supplier)"""
    for i, (front, value, _) in enumerate(_IPV6_SENTENCES)
)


@query("D1_sentences_ipv6", _IPV6_SQL)
def sentences_ipv6(spark, sf_dir):
    """Compressed IPv6 addresses, and runs that are none."""
    found = _ipv6_found(spark, sf_dir).select("k", "sentence", F.explode("spans").alias("s"))
    return found.select("k", "sentence", "s.start", "s.end", "s.text")


@query(
    "A9_quality_ipv6",
    f"""WITH gold AS ({_IPV6_SQL})
        SELECT count(*) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn,
          count(*) AS entity_count FROM gold""",
)
def quality_ipv6(spark, sf_dir):
    """Scores of the detected addresses against those put into the sentences."""
    predicted = reports.long_spans(_ipv6_found(spark, sf_dir), ["k", "sentence"])
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    gold = [
        F.struct(
            F.lit(i).alias("sentence"),
            F.lit(len(_LEAD + front)).alias("start"),
            (F.lit(len(_LEAD + front)) + F.length(F.expr(value))).alias("end"),
        )
        for i, (front, value, _) in enumerate(_IPV6_SENTENCES)
    ]
    truth = rows.select("k", F.explode(F.array(*gold)).alias("g")).select("k", "g.*")
    found = quality.scores(predicted, truth, ["k", "sentence"])
    return found.select("tp", "fp", "fn", "entity_count")
