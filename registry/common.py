"""Shared pieces of the registered queries: tables, policies, oracle SQL snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import model
from veilframe.functions.spans import Pattern
from veilframe.operators.detect import IPV4_OCTET, builtin, with_spans
from veilframe.session import spread

QUERIES: dict = {}
ORACLES: dict = {}

SEED = 7
SECRET = r'(?:token|secret|password|api_key) = "[^"]*"'
MAIN = ["CREDIT_CARD", "EMAIL_ADDRESS", "IP_ADDRESS", "NUMERIC_VALUE", "PHONE_NUMBER"]

# Oracle forms of the patterns (RE2 has no look-around).
EMAIL_RE = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"
IP_RE = r"[0-9]+(?:[.][0-9]+)+"
CARD_RE = r"[0-9](?:[ -]?[0-9]){12,18}"
NUMBER_RE = r"[0-9]+(?:[.,][0-9]+)*"
PHONE_RE = (
    r"(?:[+]?[0-9]{1,3}[ .-]?)?(?:[(][0-9]{3}[)][ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|[+][0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|[0-9]{3}-[0-9]{4}"
)
STANDALONE = (
    "NOT regexp_matches(before, '[A-Za-z0-9_]$') "
    "AND NOT regexp_matches(after, '^[A-Za-z0-9_]')"
)
NOT_IN_NUMBER = (
    "NOT regexp_matches(before, '[A-Za-z0-9][-./]?$') "
    "AND NOT regexp_matches(after, '^(?:[A-Za-z0-9]|[-/][0-9])')"
)
IP_OK = (
    f"regexp_matches(value, '^{IPV4_OCTET}(?:[.]{IPV4_OCTET}){{3}}$') AND {STANDALONE}"
)
PHONE_OK = (
    "length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 "
    f"AND {NOT_IN_NUMBER}"
)
RULES = {
    "CREDIT_CARD": (CARD_RE, STANDALONE, 0.9),
    "EMAIL_ADDRESS": (EMAIL_RE, "true", 0.9),
    "IP_ADDRESS": (IP_RE, IP_OK, 0.9),
    "NUMERIC_VALUE": (NUMBER_RE, STANDALONE, 0.7),
    "PHONE_NUMBER": (PHONE_RE, PHONE_OK, 0.9),
}


def query(name: str, oracle: str | None = None):
    """Registers a query under ``name`` with its oracle SQL."""

    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def secret_pattern() -> Pattern:
    return Pattern("SECRET", SECRET, model.SCORE_USER_RULE)


#: Labels and rules of a caller's span table; its terms overlap each other.
GIVEN_RULES = {
    "SECRET": (SECRET, "true", 0.95),
    "TERM": ("[a-z]+tion(?: [a-z]+)?", "true", 0.6),
    "TERM_END": ("[a-z]+ [a-z]+tion", "true", 0.6),
}


def given_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the spans a caller supplies as ``spans``: all matches of some patterns
    in the whole texts, overlaps and all, last first, and one beyond the end of the text."""
    rules = [Pattern(label, regex, score) for label, (regex, _, score) in GIVEN_RULES.items()]
    found = with_spans(documents(spark, sf_dir), [*builtin(MAIN), *rules], overlaps=True)
    return found.withColumn(
        "spans",
        F.expr(
            "concat(array(named_struct('start', length(text) - 1, 'end', length(text) + 1,"
            " 'label', 'TERM', 'text', '', 'score', 1.0D)), transform(reverse(spans), x ->"
            " named_struct('start', x.start, 'end', x.end, 'label', x.label, 'text', x.text,"
            " 'score', x.score)))"
        ),
    )


def main_spans(spark: SparkSession, sf_dir: str, labels: Sequence[str] = MAIN) -> DataFrame:
    return with_spans(documents(spark, sf_dir), builtin(labels), language="lang")


# --- oracle SQL -----------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(regex: str, source: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """Rows (keys, text, i, value, start, before, after) of all matches."""
    return f"""
      SELECT {keys}, text, i, m[i] AS value, g[i] AS before, g[i + 1] AS after,
             CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)
               AS BIGINT) AS start
      FROM (SELECT {keys}, text, m, g, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT {keys}, {text} AS text,
                         regexp_extract_all({text}, {quoted(regex)}) AS m,
                         string_split_regex({text}, {quoted(regex)}) AS g
                  FROM {source}))"""


def candidates_sql(
    labels: Sequence[str] = MAIN,
    extra: dict[str, tuple[str, str, float]] | None = None,
    source: str = "documents",
    keys: str = "doc_id",
    text: str = "text",
) -> str:
    rules = {**{x: RULES[x] for x in labels}, **(extra or {})}
    parts = [
        f"""SELECT {keys}, text, '{label}' AS label, CAST({score} AS DOUBLE) AS score, value,
              start, start + length(value) AS stop
            FROM ({matches(regex, source, keys, text)}) WHERE {accept}"""
        for label, (regex, accept, score) in rules.items()
    ]
    return " UNION ALL ".join(parts)


def resolved_sql(
    labels: Sequence[str] = MAIN,
    extra: dict[str, tuple[str, str, float]] | None = None,
    source: str = "documents",
    keys: str = "doc_id",
    text: str = "text",
    candidates: str | None = None,
) -> str:
    """CTEs ending in ``resolved``: leftmost, longest, best score, label."""
    found = candidates or candidates_sql(labels, extra, source, keys, text)
    key_list = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"o.{k} = w.{k}" for k in key_list)
    using = ", ".join(key_list)
    picked = ", ".join(f"o.{k}" for k in key_list)
    return f"""WITH RECURSIVE cand AS ({found}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {using}
        ORDER BY start, stop DESC, score DESC, label, value) AS rn FROM cand),
    walk AS (
      SELECT {using}, rn, stop AS last_stop, true AS kept FROM ranked WHERE rn = 1
      UNION ALL
      SELECT {picked}, o.rn,
             CASE WHEN o.start >= w.last_stop THEN o.stop ELSE w.last_stop END,
             o.start >= w.last_stop
      FROM walk w JOIN ranked o ON {same} AND o.rn = w.rn + 1),
    resolved AS (SELECT r.* FROM ranked r JOIN walk w USING ({using}, rn) WHERE w.kept)"""


def keyed_sql(purpose: str, *values: str, seed: object = SEED) -> str:
    tail = "".join(f" || '|' || {v}" for v in values)
    return f"sha256('{seed}|{purpose}'{tail})"


def int_sql(purpose: str, size: int, *values: str, seed: object = SEED) -> str:
    return f"(CAST('0x' || substr({keyed_sql(purpose, *values, seed=seed)}, 1, 15) AS BIGINT) % {size})"


def token_sql(label: str, value: str, seed: object = SEED, width: int = 16) -> str:
    return f"('[' || {label} || '_' || substr({keyed_sql('token', label, value, seed=seed)}, 1, {width}) || ']')"


def splice_sql(resolved: str, new: str, keys: str = "doc_id", source: str = "documents", text: str = "text") -> str:
    """SELECT keys, redacted_text, n over all rows of ``source``; ``new`` is an expression
    over a row of ``resolved``."""
    return f"""{resolved},
    pieces AS (SELECT {keys}, start, stop,
        substr(text, coalesce(lag(stop) OVER (PARTITION BY {keys} ORDER BY start), 0) + 1,
               start - coalesce(lag(stop) OVER (PARTITION BY {keys} ORDER BY start), 0))
          || {new} AS piece FROM resolved),
    built AS (SELECT {keys}, string_agg(piece, '' ORDER BY start) AS head,
                     max(stop) AS last_stop, count(*) AS n FROM pieces GROUP BY {keys})
    SELECT s.{keys.replace(', ', ', s.')},
           coalesce(b.head || substr(s.{text}, b.last_stop + 1), s.{text}) AS redacted_text,
           coalesce(b.n, 0) AS n_spans
    FROM {source} s LEFT JOIN built b USING ({keys})"""


def scramble_sql(value: str, purpose: str = "Scramble", seed: object = SEED) -> str:
    """The keyed per-character substitution, written out."""
    block = f"sha256('{seed}|{purpose}|' || {value} || '|' || CAST(((i - 1) // 16) * 16 AS VARCHAR))"
    r = f"CAST('0x' || substr({block}, CAST(((i - 1) % 16) * 4 + 1 AS BIGINT), 4) AS BIGINT)"
    c = f"substr({value}, CAST(i AS BIGINT), 1)"
    return f"""array_to_string(list_transform(range(1, length({value}) + 1), lambda i:
      CASE WHEN regexp_matches({c}, '^[0-9]$')
             THEN chr(CAST((ascii({c}) - 48 + 1 + {r} % 9) % 10 + 48 AS INTEGER))
           WHEN regexp_matches({c}, '^[A-Z]$')
             THEN chr(CAST((ascii({c}) - 65 + 1 + {r} % 25) % 26 + 65 AS INTEGER))
           WHEN regexp_matches({c}, '^[a-z]$')
             THEN chr(CAST((ascii({c}) - 97 + 1 + {r} % 25) % 26 + 97 AS INTEGER))
           WHEN regexp_matches({c}, '^\\p{{Lu}}$') THEN chr(CAST({r} % 26 + 65 AS INTEGER))
           WHEN regexp_matches({c}, '^\\p{{L}}$') THEN chr(CAST({r} % 26 + 97 AS INTEGER))
           ELSE {c} END), '')"""


def pool_sql(pool: Sequence[str]) -> str:
    return "[" + ", ".join(quoted(p) for p in pool) + "]"
