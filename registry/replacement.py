"""Redaction, tokenisation and synthesis queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilframe import pools
from veilframe.functions.spans import restore, usage
from veilframe.functions.sql import col, fn
from veilframe.functions.synth import (
    company,
    date,
    generate,
    grouped_year,
    scramble,
    synthesize,
)
from veilframe.functions.tokens import token
from veilframe.operators import policies, reports, vault
from veilframe.operators.detect import builtin, with_spans
from veilframe.operators.linking import group_entities
from veilframe.operators.redact import (
    override,
    redact_columns,
    redact_frame,
    redact_known,
    redact_structured,
)
from veilframe.options import (
    AddressOptions,
    AgeOptions,
    DateOptions,
    EmailOptions,
    NameOptions,
    NumericOptions,
    Options,
    PhoneOptions,
)
from veilframe.policy import Policy
from veilframe.session import checkpoint_dir, settle, spread
from veilframe.sources import files, texts

from .common import (
    GIVEN_RULES,
    MAIN,
    SECRET,
    SEED,
    documents,
    given_spans,
    int_sql,
    main_spans,
    matches,
    pool_sql,
    query,
    resolved_sql,
    RULES,
    scramble_sql,
    secret_pattern,
    splice_sql,
    table,
    token_sql,
)

_SECRET_RULE = {"SECRET": (SECRET, "true", 0.95)}
_KEEP = ["CREDIT_CARD", "EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER"]


def _policy(**extra) -> Policy:
    return Policy(
        custom={"SECRET": [SECRET]}, custom_entities=["SECRET"], seed=SEED, **extra
    )


def _redacted(spark, sf_dir, policy=None, labels=_KEEP):
    """Documents redacted with a few labels and the secret rule."""
    from veilframe.operators.redact import apply_spans

    found = with_spans(documents(spark, sf_dir), [*builtin(labels), secret_pattern()])
    return apply_spans(found, policy or _policy(), key="doc_id")


_REDACTED_SQL = splice_sql(
    resolved_sql(_KEEP, _SECRET_RULE), token_sql("label", "value")
)


@query("R2_redact_documents", _REDACTED_SQL)
def redact_documents(spark, sf_dir):
    done = _redacted(spark, sf_dir)
    return done.select(
        "doc_id", "redacted_text", fn.size(col("spans")).column().alias("n_spans")
    )


@query(
    "R1_new_offsets",
    resolved_sql(_KEEP, _SECRET_RULE)
    + f""", t AS (SELECT *, {token_sql('label', 'value')} AS new_text FROM resolved),
    s AS (SELECT *, coalesce(sum(length(new_text) - (stop - start)) OVER (
            PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM t)
    SELECT doc_id, start, stop AS "end", CAST(start + shift AS BIGINT) AS new_start,
      CAST(start + shift + length(new_text) AS BIGINT) AS new_end, new_text FROM s""",
)
def new_offsets(spark, sf_dir):
    done = _redacted(spark, sf_dir)
    return done.select("doc_id", reports.exploded("spans").alias("s")).select(
        "doc_id", "s.start", "s.end", "s.new_start", "s.new_end", "s.new_text"
    )


@query("R1_restore", "SELECT doc_id, true AS same, n_chars FROM documents")
def restored(spark, sf_dir):
    """Substituting the originals back restores every text."""
    done = _redacted(spark, sf_dir)
    back = restore(col("redacted_text"), col("spans"))
    return done.select("doc_id", (back == col("text")).column().alias("same"), "n_chars")


@query("R1_redact_all_labels")
def redact_all_labels(spark, sf_dir):
    """All built-in labels; the restore invariant is checked per document."""
    done = redact_frame(documents(spark, sf_dir), Policy(seed=SEED), key="doc_id")
    back = restore(col("redacted_text"), col("spans"))
    return done.select(
        "doc_id",
        fn.size(col("spans")).column().alias("n_spans"),
        F.length("redacted_text").alias("n_chars"),
        (back == col("text")).column().alias("same"),
        "usage",
    )


@query(
    "R3_vault",
    resolved_sql(_KEEP, _SECRET_RULE)
    + f" SELECT DISTINCT {token_sql('label', 'value')} AS token, label, value AS text FROM resolved",
)
def build_vault(spark, sf_dir):
    return vault.vault_of(_redacted(spark, sf_dir)).drop("n")


@query("R3_unredact", "SELECT doc_id, text AS unredacted_text FROM documents")
def unredact(spark, sf_dir):
    done = settle(_redacted(spark, sf_dir).select("doc_id", "redacted_text", "spans"))
    store = settle(vault.vault_of(done))
    back = vault.unredact(done.select("doc_id", "redacted_text"), store, "doc_id")
    return back.select("doc_id", "unredacted_text")


@query("R3_unredact_large_vault", "SELECT doc_id, text AS unredacted_text FROM documents")
def unredact_large(spark, sf_dir):
    """The join taken when the originals are too many for a dictionary, on a table stored in
    buckets: tokens are shuffled, texts are not."""
    done = vault.store_bucketed(
        _redacted(spark, sf_dir).select("doc_id", "redacted_text", "spans"), "doc_id"
    )
    store = settle(vault.vault_of(done))
    back = vault.unredact(
        done.select("doc_id", "redacted_text"), store, "doc_id", broadcast=False
    )
    return back.select("doc_id", "unredacted_text")


@query(
    "R3_vault_collisions",
    resolved_sql(_KEEP, _SECRET_RULE)
    + """ , t AS (SELECT DISTINCT substr(label, 1, 2) AS token, value FROM resolved)
      SELECT token, count(*) AS n_texts FROM t GROUP BY token HAVING count(*) > 1""",
)
def vault_collisions(spark, sf_dir):
    """The collision check, on deliberately short tokens (two letters of the label)."""
    full = vault.vault_of(_redacted(spark, sf_dir))
    short = full.select(F.substring("label", 1, 2).alias("token"), "label", "text").distinct()
    return vault.collisions(short)


@query(
    "R4_seeds",
    resolved_sql(_KEEP)
    + f""" SELECT doc_id, start, {token_sql('label', 'value', seed=1)} AS one,
        {token_sql('label', 'value', seed=2)} AS two,
        {token_sql('label', 'value', seed='default')} AS none FROM resolved""",
)
def seeds(spark, sf_dir):
    found = reports.long_spans(main_spans(spark, sf_dir, _KEEP), ["doc_id"])
    label, text = col("label"), col("text")
    return found.select(
        "doc_id",
        "start",
        token(label, text, 1).column().alias("one"),
        token(label, text, 2).column().alias("two"),
        token(label, text, None).column().alias("none"),
    )


_ONE_PER_NAME = f"""list_extract({pool_sql(pools.COMPANY_WORDS)},
  CAST({int_sql('Company', len(pools.COMPANY_WORDS), 'lower(c_name)')} + 1 AS BIGINT)) || ' ' ||
  list_extract({pool_sql(pools.COMPANY_ENDINGS)},
  CAST({int_sql('CompanyEnding', len(pools.COMPANY_ENDINGS), 'lower(c_name)')} + 1 AS BIGINT))"""


@query("R6_company_names", f"SELECT c_custkey, {_ONE_PER_NAME} AS c_name FROM customer")
def company_names(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", company(col("c_name"), SEED).column().alias("c_name"))


@query(
    "R7_swaps_and_constant",
    f"""SELECT c_custkey,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSES' WHEN 'MACHINERY' THEN '7'
        ELSE {scramble_sql('c_mktsegment')} END AS swapped,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSES' ELSE 'True' END AS constant
    FROM customer""",
)
def swaps_and_constant(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    value = col("c_mktsegment")
    swaps = Options(swaps={"BUILDING": "HOUSES", "MACHINERY": 7})
    constant = Options(swaps={"BUILDING": "HOUSES"}, constant=True)
    return df.select(
        "c_custkey",
        synthesize(value, "NRP", swaps, SEED).column().alias("swapped"),
        synthesize(value, "NRP", constant, SEED).column().alias("constant"),
    )


_GIVEN = pools.MALE_NAMES + pools.FEMALE_NAMES


def _other_sql(pool, index: str, value: str) -> str:
    entry = f"list_extract({pool_sql(pool)}, CAST({index} + 1 AS BIGINT))"
    following = f"list_extract({pool_sql(pool)}, CAST(({index} + 1) % {len(pool)} + 1 AS BIGINT))"
    return f"CASE WHEN lower({entry}) = lower({value}) THEN {following} ELSE {entry} END"


@query(
    "R9_names",
    f"""WITH w AS (SELECT doc_id, i, value FROM ({matches('[A-Z][a-z]+', "(SELECT item_id AS doc_id, text FROM benchmark)")}))
    SELECT doc_id, i, value,
      {_other_sql(_GIVEN, int_sql('NameV1', len(_GIVEN), 'lower(value)'), 'value')} AS any_case,
      {_other_sql(_GIVEN, int_sql('NameV1', len(_GIVEN), 'value'), 'value')} AS exact_case,
      {_other_sql(pools.FAMILY_NAMES, int_sql('NameV1Family', len(pools.FAMILY_NAMES), 'lower(value)'), 'value')} AS family
    FROM w""",
)
def names(spark, sf_dir):
    """Capitalised words of the benchmark texts treated as names."""
    words = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"),
        F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("i", "value"),
    )
    value = col("value")
    return words.select(
        "doc_id",
        (F.col("i") + 1).alias("i"),
        "value",
        synthesize(value, "NAME_GIVEN", None, SEED).column().alias("any_case"),
        synthesize(value, "NAME_GIVEN", NameOptions(case_sensitive=True), SEED)
        .column()
        .alias("exact_case"),
        synthesize(value, "NAME_FAMILY", None, SEED).column().alias("family"),
    )


_HOST = "regexp_replace(substr(value, position('@' in value) + 1), '[.][^.]*$', '')"


@query(
    "R10_emails",
    f"""SELECT doc_id, start,
      {scramble_sql("split_part(value, '@', 1)", 'EmailLocalV1')} || '@' || split_part(value, '@', 2) AS keeps_domain,
      {scramble_sql("split_part(value, '@', 1)", 'EmailLocalV1')} || '@' || {scramble_sql(_HOST, 'EmailDomainV1')}
        || regexp_extract(value, '([.][^.]*)$', 1) AS new_domain
    FROM ({matches(RULES['EMAIL_ADDRESS'][0])})""",
)
def emails(spark, sf_dir):
    found = reports.long_spans(main_spans(spark, sf_dir, ["EMAIL_ADDRESS"]), ["doc_id"])
    value = col("text")
    return found.select(
        "doc_id",
        "start",
        synthesize(value, "EMAIL_ADDRESS", EmailOptions(preserve_domain=True), SEED)
        .column()
        .alias("keeps_domain"),
        synthesize(value, "EMAIL_ADDRESS", None, SEED).column().alias("new_domain"),
    )


@query(
    "R11_phones",
    f"""SELECT doc_id, start,
      regexp_extract(value, '^([+][0-9]{{1,3}})[ (.-]', 1)
        || {scramble_sql("substr(value, length(regexp_extract(value, '^([+][0-9]{1,3})[ (.-]', 1)) + 1)", 'PhoneV1')} AS scrambled,
      CAST({int_sql('PhoneV1Exchange', 800, 'value')} + 200 AS VARCHAR)
        || lpad(CAST({int_sql('PhoneV1Line', 10000, 'value')} AS VARCHAR), 4, '0') AS last_seven,
      right(regexp_replace(value, '[^0-9]', '', 'g'), 10)[1:3] AS area
    FROM ({matches(RULES['PHONE_NUMBER'][0])}) WHERE {RULES['PHONE_NUMBER'][1]}""",
)
def phones(spark, sf_dir):
    found = reports.long_spans(main_spans(spark, sf_dir, ["PHONE_NUMBER"]), ["doc_id"])
    value = col("text")
    us = synthesize(
        value, "PHONE_NUMBER", PhoneOptions(us_format=True, preserve_area_code=True), SEED
    )
    return found.select(
        "doc_id",
        "start",
        synthesize(value, "PHONE_NUMBER", None, SEED).column().alias("scrambled"),
        us.column().alias("us"),
    ).select(
        "doc_id",
        "start",
        "scrambled",
        F.right(F.regexp_replace("us", "[^0-9]", ""), F.lit(7)).alias("last_seven"),
        F.substring(F.right(F.regexp_replace("us", "[^0-9]", ""), F.lit(10)), 1, 3).alias("area"),
    )


_DAY = "strftime(o_orderdate, '%m-%d-%Y')"
_SHIFT = int_sql("DateV1", 15, _DAY)


@query(
    "R12_date_shift",
    f"""SELECT o_orderkey,
      strftime(o_orderdate + to_days(CAST({_SHIFT} - 7 AS INTEGER)), '%m-%d-%Y') AS shifted,
      strftime(o_orderdate + to_days(CAST({int_sql('DateV1', 15, "strftime(o_orderdate, '%B %-d, %Y')")} - 7 AS INTEGER)), '%B %-d, %Y') AS in_words,
      strftime(o_orderdate + to_days(CAST({int_sql('DateV1', 15, "strftime(o_orderdate, '%dxx%mxx%Y')")} - 7 AS INTEGER)), '%dxx%mxx%Y') AS own_form
    FROM orders""",
)
def date_shift(spark, sf_dir):
    df = spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey",
        F.date_format("o_orderdate", "MM-dd-yyyy").alias("a"),
        F.date_format("o_orderdate", "MMMM d, yyyy").alias("b"),
        F.date_format("o_orderdate", "dd'xx'MM'xx'yyyy").alias("c"),
    )
    own = DateOptions(extra_formats=("dd'xx'MM'xx'yyyy",))
    return df.select(
        "o_orderkey",
        date(col("a"), DateOptions(), SEED).column().alias("shifted"),
        date(col("b"), DateOptions(), SEED).column().alias("in_words"),
        date(col("c"), own, SEED).column().alias("own_form"),
    )


@query(
    "R13_shift_per_document",
    f"""SELECT o_orderkey, o_custkey,
      CAST({int_sql('DateV1', 2001, 'CAST(o_custkey AS VARCHAR)')} - 1000 AS BIGINT) AS days,
      strftime(o_orderdate + to_days(CAST({int_sql('DateV1', 2001, 'CAST(o_custkey AS VARCHAR)')} - 1000 AS INTEGER)), '%Y-%m-%d') AS shifted
    FROM orders""",
)
def shift_per_document(spark, sf_dir):
    """One shift per customer: differences between a customer's dates survive."""
    df = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    options = DateOptions(constant_shift=True, left_days=-1000, right_days=1000)
    new = date(col("day"), options, SEED, col("o_custkey"))
    return df.select("o_orderkey", "o_custkey", "day", new.column().alias("shifted")).select(
        "o_orderkey",
        "o_custkey",
        F.datediff(F.to_date("shifted"), F.to_date("day")).alias("days"),
        "shifted",
    )


@query(
    "R15_unparsed_dates",
    f"""SELECT o_orderkey, {scramble_sql("strftime(o_orderdate, '%Y.%m.%d')", 'DateTextV1')} AS scrambled,
      strftime(o_orderdate, '%Y.%m.%d') AS kept FROM orders""",
)
def unparsed_dates(spark, sf_dir):
    df = spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy.MM.dd").alias("d")
    )
    return df.select(
        "o_orderkey",
        date(col("d"), DateOptions(), SEED).column().alias("scrambled"),
        date(col("d"), DateOptions(scramble_unrecognized=False), SEED).column().alias("kept"),
    )


@query(
    "R16_year_group",
    """SELECT o_orderkey,
      strftime(make_date(CASE WHEN 2085 - year(o_orderdate) < 90 THEN year(o_orderdate) ELSE 1995 END, 1, 1), '%m/%d/%Y') AS grouped,
      CAST(CASE WHEN 2085 - year(o_orderdate) < 90 THEN year(o_orderdate) ELSE 1995 END AS BIGINT) AS year
    FROM orders""",
)
def year_group(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "MM/dd/yyyy"))
    options = DateOptions(group_year=True, as_of_year=2085)
    return df.select(
        "o_orderkey",
        date(col("d"), options, SEED).column().alias("grouped"),
        fn.year(grouped_year(col("o_orderdate"), 2085)).column().alias("year"),
    )


@query(
    "R17_ages",
    f"""SELECT p_partkey,
      CAST(greatest(p_size + {int_sql('AgeV1', 15, 'CAST(p_size AS VARCHAR)')} - 7, 0) AS VARCHAR) AS shifted,
      CASE WHEN p_size * 3 <= 89 THEN CAST(p_size * 3 AS VARCHAR) ELSE '90+' END || ' years old' AS passed
    FROM part""",
)
def ages(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_size").cast("string").alias("age"),
        F.concat((F.col("p_size") * 3).cast("string"), F.lit(" years old")).alias("old"),
    )
    return df.select(
        "p_partkey",
        synthesize(col("age"), "PERSON_AGE", None, SEED).column().alias("shifted"),
        synthesize(col("old"), "PERSON_AGE", AgeOptions(pass_through_to_89=True), SEED)
        .column()
        .alias("passed"),
    )


_ZIP = "lpad(CAST((c_custkey * 37) % 100000 AS VARCHAR), 5, '0')"


@query(
    "R18_zips",
    f"""SELECT c_custkey,
      substr({_ZIP}, 1, 3) || lpad(CAST({int_sql('ZipV1', 99, _ZIP)} + 1 AS VARCHAR), 2, '0') AS filled,
      substr({_ZIP}, 1, 3) || '00' AS zeros, substr({_ZIP}, 1, 3) AS three,
      regexp_replace('SW' || {_ZIP}, '[A-Za-z0-9]', '0', 'g') AS abroad
    FROM customer""",
)
def zips(spark, sf_dir):
    """Postal codes derived from the customer key."""
    df = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lpad(((F.col("c_custkey") * 37) % 100000).cast("string"), 5, "0").alias("zip"),
    )
    value = col("zip")

    def made(options: AddressOptions, source=value):
        return generate(source, "LOCATION_ZIP", options, SEED).column()

    return df.select(
        "c_custkey",
        made(AddressOptions()).alias("filled"),
        made(AddressOptions(replace_truncated_zeros=False)).alias("zeros"),
        made(AddressOptions(three_digit_zips=True)).alias("three"),
        made(AddressOptions(foreign_zeros=True), fn.concat("SW", value)).alias("abroad"),
    )


_CITY = int_sql("AddressV1City", len(pools.CITIES), "lower(n_name)")


@query(
    "R18_addresses",
    f"""SELECT c_custkey, n_name,
      {_other_sql(pools.CITIES, _CITY, 'n_name')} AS city,
      {scramble_sql('n_name', 'AddressV1')} AS same_case, n_name AS state
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def addresses(spark, sf_dir):
    df = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    value = col("n_name")
    return df.select(
        "c_custkey",
        "n_name",
        generate(value, "LOCATION_CITY", AddressOptions(), SEED).column().alias("city"),
        generate(value, "LOCATION_CITY", AddressOptions(realistic=False), SEED)
        .column()
        .alias("same_case"),
        generate(value, "LOCATION_STATE", AddressOptions(), SEED).column().alias("state"),
    )


@query(
    "R19_scramble",
    resolved_sql(["NUMERIC_VALUE"])
    + f""" SELECT doc_id, start, {scramble_sql('value', 'NumericV1')} AS numeric_value,
        CAST({int_sql('IntegerKeyV1', 900000000000, 'value')} + 100000000000 AS VARCHAR) AS integer_key,
        {scramble_sql("substr(text, greatest(start - 8, 1), 20)")} AS around
        FROM resolved""",
)
def scrambled(spark, sf_dir):
    df = main_spans(spark, sf_dir, ["NUMERIC_VALUE"])
    found = df.select("doc_id", "text", reports.exploded("spans").alias("s"))
    around = fn.substring(col("text"), fn.greatest(col("s.start") - 8, 1), 20)
    values = found.select(
        "doc_id", "s.start", F.col("s.text").alias("value"), around.column().alias("near")
    )
    integer_key = NumericOptions(integer_key=True)
    return values.select(
        "doc_id",
        "start",
        synthesize(col("value"), "NUMERIC_VALUE", None, SEED).column().alias("numeric_value"),
        synthesize(col("value"), "NUMERIC_VALUE", integer_key, SEED)
        .column()
        .alias("integer_key"),
        scramble(col("near"), SEED).column().alias("around"),
    )


@query(
    "R20_cards",
    f"""WITH c AS (SELECT doc_id, start, value, {scramble_sql('value', 'Card')} AS s
          FROM ({matches(RULES['CREDIT_CARD'][0])}) WHERE {RULES['CREDIT_CARD'][1]})
        SELECT doc_id, start, substr(s, 1, length(s) - 1) AS head, true AS luhn FROM c""",
)
def cards(spark, sf_dir):
    found = reports.long_spans(main_spans(spark, sf_dir, ["CREDIT_CARD"]), ["doc_id"])
    new = found.select(
        "doc_id", "start", synthesize(col("text"), "CREDIT_CARD", None, SEED).column().alias("n")
    )
    return new.select(
        "doc_id",
        "start",
        F.expr("substring(n, 1, length(n) - 1)").alias("head"),
        F.expr("luhn_check(regexp_replace(n, '[^0-9]', ''))").alias("luhn"),
    )


@query(
    "R20_ip_and_money",
    f"""SELECT doc_id, start, concat_ws('.', {', '.join(f"CAST({int_sql(f'Ip{i}', 254, 'value')} + 1 AS VARCHAR)" for i in range(4))}) AS ip,
        {scramble_sql("'$' || value", 'Money')} AS money
      FROM ({matches(RULES['IP_ADDRESS'][0])}) WHERE {RULES['IP_ADDRESS'][1]}""",
)
def ip_and_money(spark, sf_dir):
    found = reports.long_spans(main_spans(spark, sf_dir, ["IP_ADDRESS"]), ["doc_id"])
    return found.select(
        "doc_id",
        "start",
        synthesize(col("text"), "IP_ADDRESS", None, SEED).column().alias("ip"),
        synthesize(fn.concat("$", col("text")), "MONEY", None, SEED).column().alias("money"),
    )


@query(
    "R20_other_generators",
    f"""SELECT s_suppkey,
      'https://' || {scramble_sql("'example.com/' || s_name", 'Url')} AS url,
      {scramble_sql("'123-45-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0')", 'Ssn')} AS ssn,
      {scramble_sql("lpad(CAST(s_suppkey AS VARCHAR), 3, '0')", 'Cvv')} AS cvv,
      lpad(CAST({int_sql('ExpMonth', 12, "'09/' || CAST(s_nationkey + 10 AS VARCHAR)")} + 1 AS VARCHAR), 2, '0') || '/' ||
        lpad(CAST(s_nationkey + 10 + {int_sql('ExpYear', 4, "'09/' || CAST(s_nationkey + 10 AS VARCHAR)")} + 1 AS VARCHAR), 2, '0') AS expiry
    FROM supplier""",
)
def other_generators(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("https://example.com/"), "s_name").alias("u"),
        F.concat(F.lit("123-45-"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("n"),
        F.lpad(F.col("s_suppkey").cast("string"), 3, "0").alias("v"),
        F.concat(F.lit("09/"), (F.col("s_nationkey") + 10).cast("string")).alias("e"),
    )
    return df.select(
        "s_suppkey",
        synthesize(col("u"), "URL", None, SEED).column().alias("url"),
        synthesize(col("n"), "US_SSN", None, SEED).column().alias("ssn"),
        synthesize(col("v"), "CVV", None, SEED).column().alias("cvv"),
        synthesize(col("e"), "CC_EXP", None, SEED).column().alias("expiry"),
    )


@query(
    "R21_override",
    splice_sql(
        resolved_sql(_KEEP, _SECRET_RULE),
        f"CASE WHEN label = 'CREDIT_CARD' THEN repeat('x', length(value)) ELSE {token_sql('label', 'value')} END",
    ),
)
def overridden(spark, sf_dir):
    done = _redacted(spark, sf_dir)
    masked = override(
        col("text"),
        col("spans"),
        {"CREDIT_CARD": lambda s: fn.repeat("x", fn.length(s["text"]))},
    )
    out = done.withColumn("o", masked.column())
    return out.select(
        "doc_id", "o.redacted_text", F.expr("size(o.spans)").alias("n_spans")
    )


@query(
    "R22_structured_columns",
    f"""SELECT c_custkey, {_ONE_PER_NAME} AS c_name,
      {scramble_sql('c_mktsegment')} AS c_mktsegment FROM customer""",
)
def structured_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return df.transform(
        redact_structured({"c_name": "ORGANIZATION", "c_mktsegment": "NRP"}, seed=SEED)
    )


@query(
    "R23_group_entities",
    """WITH w AS (SELECT item_id, lower(a) AS a, lower(b) AS b, a AS wa, b AS wb, s1, s2 FROM (
          SELECT item_id, regexp_extract(text, '^([^ ]+) ([^ ]+)', 1) AS a,
                 regexp_extract(text, '^([^ ]+) ([^ ]+)', 2) AS b, 0 AS s1,
                 length(regexp_extract(text, '^([^ ]+) ([^ ]+)', 1)) + 1 AS s2 FROM benchmark))
      SELECT item_id, 0 AS start, wa || ' ' || wb AS text, wa || ' ' || wb AS representative FROM w
      UNION ALL SELECT item_id, 1000 + s1, wa, wa || ' ' || wb FROM w
      UNION ALL SELECT item_id, 1000 + s2, wb, wa || ' ' || wb FROM w
      UNION ALL SELECT item_id, 3000, 'Mr. ' || wb, wa || ' ' || wb FROM w""",
)
def grouped_entities(spark, sf_dir):
    """First two words of a text as a full name, mentioned again in parts."""
    pair = r"'^([^ ]+) ([^ ]+)'"
    df = table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.expr(f"regexp_extract(text, {pair}, 1)").alias("a"),
        F.expr(f"regexp_extract(text, {pair}, 2)").alias("b"),
    )
    mention = (
        "array(struct(0 AS start, concat(a, ' ', b) AS text),"
        " struct(1000 AS start, a AS text),"
        " struct(1000 + length(a) + 1 AS start, b AS text),"
        " struct(3000 AS start, concat('Mr. ', b) AS text))"
    )
    spans = df.select("item_id", F.explode(F.expr(mention)).alias("m")).select(
        "item_id", "m.start", F.lit("PERSON").alias("label"), "m.text"
    )
    return group_entities(spans, "item_id").select(
        "item_id", "start", "text", "representative"
    )


@query(
    "R24_usage",
    r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\r\n\f\x0B]+')) AS usage FROM documents",
)
def word_usage(spark, sf_dir):
    df = documents(spark, sf_dir)
    return df.select("doc_id", usage(col("text")).column().alias("usage"))


@query(
    "R25_redact_columns",
    f"""SELECT o_orderkey, regexp_replace(o_orderpriority, '^[0-9]', {token_sql("'NUMERIC_VALUE'", "substr(o_orderpriority, 1, 1)")}) AS o_orderpriority,
        {token_sql("'NUMERIC_VALUE'", "CAST(o_custkey AS VARCHAR)")} AS customer
      FROM orders""",
)
def redacted_columns(spark, sf_dir):
    """Two text columns of a frame in one ``transform``."""
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.col("o_custkey").cast("string").alias("customer"),
    )
    policy = Policy(
        default="Off", config={"NUMERIC_VALUE": "Redaction"}, seed=SEED, claim_off=False
    )
    return df.transform(redact_columns(["o_orderpriority", "customer"], policy))


_MIXED = {
    "CREDIT_CARD": "Redaction",
    "EMAIL_ADDRESS": "Off",
    "IP_ADDRESS": "Synthesis",
    "PHONE_NUMBER": "GroupingSynthesis",
    "SECRET": "Redaction",
}
_IP_NEW = "concat_ws('.', " + ", ".join(
    f"CAST({int_sql(f'Ip{i}', 254, 'value')} + 1 AS VARCHAR)" for i in range(4)
) + ")"


@query(
    "R26_mixed_states",
    splice_sql(
        resolved_sql(_KEEP, _SECRET_RULE)
        + ", all_spans AS (SELECT * FROM resolved)",
        f"""CASE WHEN label = 'IP_ADDRESS' THEN {_IP_NEW}
             WHEN label = 'PHONE_NUMBER' THEN regexp_extract(value, '^([+][0-9]{{1,3}})[ (.-]', 1)
               || {scramble_sql("substr(value, length(regexp_extract(value, '^([+][0-9]{1,3})[ (.-]', 1)) + 1)", 'PhoneV1')}
             WHEN label = 'EMAIL_ADDRESS' THEN value
             ELSE {token_sql('label', 'value')} END""",
    ).replace("coalesce(b.n, 0) AS n_spans", "length(coalesce(b.head || substr(s.text, b.last_stop + 1), s.text)) AS n_chars"),
)
def mixed_states(spark, sf_dir):
    done = _redacted(spark, sf_dir, _policy(config=_MIXED))
    return done.select("doc_id", "redacted_text", F.length("redacted_text").alias("n_chars"))


@query(
    "D9_redact_known",
    splice_sql(
        resolved_sql(
            candidates="""SELECT doc_id, text, 'PERSON' AS label, 0.9 AS score,
              regexp_extract(text, '^[^ ]+') AS value, 0 AS start,
              length(regexp_extract(text, '^[^ ]+')) AS stop FROM documents
              WHERE regexp_extract(text, '^[^ ]+') <> ''"""
        ),
        token_sql("label", "value"),
    ),
)
def redact_given(spark, sf_dir):
    """First word of each text as a caller-supplied entity; no detection."""
    df = documents(spark, sf_dir).withColumn("w", F.expr("regexp_extract(text, '^[^ ]+', 0)"))
    df = df.withColumn(
        "spans",
        F.expr(
            "filter(array(named_struct('start', 0, 'end', length(w), 'label', 'PERSON',"
            " 'text', w, 'score', 0.9D)), x -> x.end > 0)"
        ),
    )
    done = redact_known(df, Policy(seed=SEED))
    return done.select(
        "doc_id", "redacted_text", fn.size(col("spans")).column().alias("n_spans")
    )


@query(
    "D9_redact_known_whole",
    splice_sql(resolved_sql(MAIN, GIVEN_RULES), token_sql("label", "value")),
)
def redact_given_whole(spark, sf_dir):
    """Caller-supplied entities all over the texts, many of them overlapping."""
    done = redact_known(given_spans(spark, sf_dir), Policy(seed=SEED))
    return done.select(
        "doc_id", "redacted_text", fn.size(col("spans")).column().alias("n_spans")
    )


@query("S13_file_redaction_whole", _REDACTED_SQL)
def file_redaction_whole(spark, sf_dir):
    """A document as a file: the whole text is detected and redacted as R1 does."""
    states = {label: "Redaction" for label in [*_KEEP, "SECRET"]}
    policy = _policy(default="Off", config=states, claim_off=False)
    done = redact_frame(documents(spark, sf_dir), policy, key="doc_id")
    return done.select(
        "doc_id", "redacted_text", fn.size(col("spans")).column().alias("n_spans")
    )


@query(
    "S13_files_written",
    f"""SELECT (doc_id % 7) || '/' || (doc_id // 7) || '.txt' AS file_name, redacted_text AS text
        FROM ({_REDACTED_SQL})""",
)
def files_written(spark, sf_dir):
    """Every document as a file: redacted, written under its name, and read back from there.
    Files of one base name lie in several folders."""
    states = {label: "Redaction" for label in [*_KEEP, "SECRET"]}
    policy = _policy(default="Off", config=states, claim_off=False)
    done = redact_frame(documents(spark, sf_dir), policy, key="doc_id")
    name = F.concat_ws("", F.col("doc_id") % 7, F.lit("/"), F.expr("doc_id div 7"), F.lit(".txt"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/veilframe-files-{uuid.uuid4().hex}"
    texts.write_files(done.withColumn("file_name", name), folder, "file_name", "redacted_text")
    return files.read(spark, folder)


@query(
    "S7_default_names",
    """SELECT coalesce(CASE WHEN lang = 'en' THEN 'doc' || doc_id END,
              'training_file_' || (row_number() OVER (ORDER BY doc_id) - 1)) || '.txt' AS "fileName",
              length(text) AS n_chars FROM documents""",
)
def default_names(spark, sf_dir):
    """Documents as JSON lines in several files; those without a name are counted."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/veilframe-lines-{uuid.uuid4().hex}"
    named = F.when(F.col("lang") == "en", F.concat(F.lit("doc"), F.col("doc_id")))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", named.alias("fileName"), "text"
    ).repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").drop("doc_id")
    docs.write.json(folder)
    return texts.read_training_rows(spark, folder).select(
        "fileName", F.length("text").alias("n_chars")
    )


_CSV = """'"' || replace(source, '"', '""') || '","' || replace(text, '"', '""') || '"'"""


@query(
    "S4_csv_lines",
    f"SELECT doc_id, {_CSV} AS line, source AS source_back, text AS text_back FROM documents",
)
def csv_lines(spark, sf_dir):
    """Whole texts, line ends and quotes in them, as quoted CSV and back."""
    options = {k: str(v) for k, v in texts.csv_options(null_marker=None).items()}
    options |= {"quoteAll": "true", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.to_csv(F.struct("source", "text"), options).alias("line")
    )
    limits = {"maxCharsPerColumn": "-1"}
    back = F.from_csv("line", "source string, text string", options | limits)
    return lines.withColumn("b", back).select(
        "doc_id", "line", F.col("b.source").alias("source_back"), F.col("b.text").alias("text_back")
    )


@query("C1_stored_policy", _REDACTED_SQL)
def stored_policy(spark, sf_dir):
    """A policy written as rows and read back drives the redaction: lists, states and seed."""
    states = {label: "Redaction" for label in _KEEP}
    policy = _policy(default="Off", config=states | {"SECRET": "Redaction"}, claim_off=False)
    path = f"{checkpoint_dir(spark).rstrip('/')}/veilframe-policy-{uuid.uuid4().hex}"
    policies.to_rows(spark, "documents", policy).write.parquet(path)
    read = policies.from_rows(spark.read.parquet(path), "documents")
    done = redact_frame(documents(spark, sf_dir), read, key="doc_id")
    return done.select(
        "doc_id", "redacted_text", fn.size(col("spans")).column().alias("n_spans")
    )
