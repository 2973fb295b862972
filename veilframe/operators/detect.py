"""Detection: texts in, candidate spans out, all as Sql expressions.

A pattern matches a *maximal* candidate with a portable expression (no look-around) and
an ``accept`` predicate decides on the value and its neighbours: ranges, checksums,
dictionary membership.  Labels that are off are never compiled into the plan.
"""

from __future__ import annotations

from dataclasses import replace
from collections.abc import Iterable, Mapping, Sequence


from pyspark.sql import DataFrame

from .. import model, pools
from ..functions.spans import (
    CANDIDATE,
    Pattern,
    candidates,
    cuttings,
    located,
    mark_safe,
    resolve,
    to_candidates,
    to_spans,
    without_blocked,
)
from ..functions.arrays import chars, empty, let
from ..functions.sql import Sql, col, fn, lit, named, struct, when

# --- predicates on candidates -------------------------------------------------------


def standalone(value: Sql, before: Sql, after: Sql) -> Sql:
    """Not glued to a longer word or number."""
    return ~before.rlike(r"[A-Za-z0-9_]\z") & ~after.rlike("^[A-Za-z0-9_]")


def digits_of(value: Sql) -> Sql:
    return fn.regexp_replace(value, "[^0-9]", "")


def luhn_valid(value: Sql) -> Sql:
    return fn.luhn_check(digits_of(value))


def aba_valid(value: Sql) -> Sql:
    """Routing numbers: weights 3, 7, 1 repeated, sum divisible by ten."""
    weights = fn.array(*[lit(w) for w in (3, 7, 1)])
    places = fn.transform(
        chars(digits_of(value)),
        lambda d, i: d.cast("int") * fn.element_at(weights, i % 3 + 1),
    )
    total = fn.aggregate(places, lit(0), lambda acc, x: acc + x)
    return (fn.length(digits_of(value)) == 9) & (total % 10 == 0)


def iban_valid(value: Sql) -> Sql:
    """Country code and check digits moved to the end, letters as 10..35, modulo 97."""
    compact = fn.regexp_replace(value, "[^A-Z0-9]", "")
    turned = fn.concat(fn.substring(compact, 5, 34), fn.substring(compact, 1, 4))
    remainder = fn.aggregate(
        chars(turned),
        lit(0),
        lambda acc, c: when(
            c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97
        ).otherwise((acc * 100 + fn.ascii(c) - 55) % 97),
    )
    return remainder == 1


IPV4_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def ip_valid(value: Sql, before: Sql, after: Sql) -> Sql:
    four = value.rlike(f"^{IPV4_OCTET}(?:[.]{IPV4_OCTET}){{3}}$")
    return four & standalone(value, before, after)


def ipv6_valid(value: Sql, before: Sql, after: Sql) -> Sql:
    """Eight groups, or fewer with one ``::``; IPv4 at the end stands for two groups."""
    core = fn.regexp_replace(value, f":{IPV4_OCTET}(?:[.]{IPV4_OCTET}){{3}}$", ":0:0")
    groups = fn.size(fn.filter(fn.split(core, lit(":")), lambda g: fn.length(g) > 0))
    full = ~fn.contains(core, lit("::")) & (groups == 8)
    gaps = fn.length(core) - fn.length(fn.replace(core, lit("::"), lit("")))
    short = (gaps == 2) & (groups <= 7)
    return (
        (full | short)
        & core.rlike("^[0-9A-Fa-f:]+$")
        & ~core.rlike("[0-9A-Fa-f]{5}")
        & ~before.rlike(r"::\z")
        & standalone(value, before, after)
    )


# --- built-in patterns --------------------------------------------------------------

# Groups repeat without bound and possessively: the matcher then loops instead of recursing,
# so an endless list such as "1,2,3,..." needs no stack.  What precedes a mandatory sign
# ("@", "USD") is tried only where a run begins or the last match ended, or a long run
# without the sign would be read again from each of its characters.
_DIGIT = "[0-9]"
_DAY = "[0-9]{1,2}"
_MONTH = "[JFMASOND][a-z]{2,8}"
_NUMERIC_DATE = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?"
    rf"|{_DAY}[/-]{_DAY}[/-](?:[0-9]{{4}}|[0-9]{{2}})"
    rf"|{_DAY}[/ -]{_MONTH}[/ -][0-9]{{4}}"
)
_DATE = (
    rf"{_NUMERIC_DATE}|{_MONTH}[.]? {_DAY}(?:st|nd|rd|th)?,? [0-9]{{4}}"
    rf"|{_MONTH}[- ][0-9]{{4}}"
)
_MONTH_NAMED = "(?:" + "|".join(f"{m}|{m[:3]}" for m in pools.MONTHS) + ")"
_STATES = "(?:" + "|".join(pools.US_STATES) + ")"
_IS = r"(?: is| was| number| no[.]?| id)*+[ ]?[:=#]?[ ]?[\"']?"
_SPELLED = "(?i:" + "|".join(pools.DIGIT_WORDS) + ")"


def preceded_by(words: str, check=standalone):
    """The value follows one of ``words`` and a linking word or sign."""

    def accept(value: Sql, before: Sql, after: Sql) -> Sql:
        return before.rlike(rf"(?i)(?:^|[^a-z])(?:{words}){_IS}\z") & check(
            value, before, after
        )

    return accept


def _not_in_number(value: Sql, before: Sql, after: Sql) -> Sql:
    return ~before.rlike(r"[A-Za-z0-9][-./]?\z") & ~after.rlike("^(?:[A-Za-z0-9]|[-/][0-9])")


def _date(value: Sql, before: Sql, after: Sql) -> Sql:
    named = ~value.rlike("[A-Za-z]{3}") | value.rlike(f"(?:^|[^A-Za-z]){_MONTH_NAMED}[^a-z]")
    return named & _not_in_number(value, before, after)


def _age(value: Sql, before: Sql, after: Sql) -> Sql:
    said_after = after.rlike("^(?:[ -]years?[ -]olds?|[ -]year-olds?| ?y/?o(?:[^a-z]|$))")
    said_before = before.rlike(r"(?i)(?:^|[^a-z])(?:age[d]?|turned|turning)[ :]{1,2}\z")
    return (said_after | said_before) & standalone(value, before, after)


def _phone(value: Sql, before: Sql, after: Sql) -> Sql:
    digits = fn.length(digits_of(value))
    return digits.between(7, 15) & _not_in_number(value, before, after)


def _ssn(value: Sql, before: Sql, after: Sql) -> Sql:
    return ~value.rlike("^(?:000|666|9)") & _not_in_number(value, before, after)


def _iban(value: Sql, before: Sql, after: Sql) -> Sql:
    return iban_valid(value) & standalone(value, before, after)


def _aba(value: Sql, before: Sql, after: Sql) -> Sql:
    return aba_valid(value) & standalone(value, before, after)


def _zip(value: Sql, before: Sql, after: Sql) -> Sql:
    return before.rlike(rf"(?:^|[^A-Za-z]){_STATES}[.,]?[ ]+\z") & standalone(
        value, before, after
    )


def _state(value: Sql, before: Sql, after: Sql) -> Sql:
    return (
        value.isin(pools.US_STATES)
        & before.rlike(r"[A-Za-z],? \z")
        & ~after.rlike("^[A-Za-z0-9_]")
    )


def _contextual(label: str, words: str, body: str, check=standalone) -> Pattern:
    return Pattern(
        label, body, model.SCORE_CONTEXT, accept=preceded_by(words, check), needs=_DIGIT
    )


_BUILTIN: list[Pattern] = [
    Pattern(
        "EMAIL_ADDRESS",
        r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++",
        prefix=r"(?:\G|(?<![A-Za-z0-9._%+-]))[._%+-]*+",
        needs=("@",),
    ),
    Pattern(
        "URL",
        r"(?:https?://|ftp://|www[.])[^ \t\r\n<>\"']*[A-Za-z0-9/=_#&-]",
        needs=("://", "www."),
    ),
    Pattern("IP_ADDRESS", r"(?<![0-9])[0-9]++(?:[.][0-9]++)++", accept=ip_valid, needs=_DIGIT),
    Pattern(
        "IP_ADDRESS",
        r"(?<![0-9A-Za-z_])(?:(?:::)?+[0-9A-Fa-f]++(?:::?[0-9A-Fa-f]++)++"
        r"(?:(?:[.][0-9]++){3}(?![.]?[0-9])|::)?+|::[0-9A-Fa-f]++(?:(?:[.][0-9]++){3}(?![.]?[0-9]))?+|[0-9A-Fa-f]++::)",
        accept=ipv6_valid,
        needs="::|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]",
    ),
    Pattern(
        "PHONE_NUMBER",
        r"(?=[+(0-9])(?:"
        r"(?:[+]?[0-9]{1,3}[ .-]?)?(?:[(][0-9]{3}[)][ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
        r"|[+][0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|[0-9]{3}-[0-9]{4})",
        accept=_phone,
        needs=_DIGIT,
    ),
    Pattern(
        "CREDIT_CARD", r"[0-9](?:[ -]?[0-9]){12,18}", accept=standalone, needs=_DIGIT
    ),
    Pattern("US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", accept=_ssn, needs=_DIGIT),
    Pattern(
        "US_ITIN", r"9[0-9]{2}-[0-9]{2}-[0-9]{4}", accept=_not_in_number, needs=_DIGIT
    ),
    Pattern(
        "IBAN_CODE",
        r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?",
        model.SCORE_CONTEXT,
        accept=_iban,
        needs=_DIGIT,
    ),
    Pattern(
        "MICR_CODE", r"[⑆⑇⑈⑉][0-9⑆⑇⑈⑉ -]*[⑆⑇⑈⑉]", needs=("⑆", "⑇", "⑈", "⑉")
    ),
    Pattern(
        "MONEY",
        r"[$€£¥][ ]?[0-9]++(?:,[0-9]{3})*+(?:[.][0-9]{1,2})?"
        r"|(?<![0-9])[0-9]++(?:,[0-9]{3}(?![0-9]))*+(?:[.][0-9]{1,2})? (?:USD|EUR|GBP|dollars|euros|pounds)",
        needs=_DIGIT,
    ),
    Pattern("DATE_TIME", _DATE, accept=_date, needs=_DIGIT),
    _contextual("DOB", r"born(?: on)?|d\.?o\.?b\.?|date of birth|birth date", _DATE, _date),
    Pattern("PERSON_AGE", r"[0-9]{1,3}", accept=_age, needs=_DIGIT),
    Pattern(
        "LOCATION_ZIP",
        r"[0-9]{5}(?:-[0-9]{4})?",
        model.SCORE_CONTEXT,
        accept=_zip,
        needs=_DIGIT,
    ),
    Pattern("LOCATION_STATE", "[A-Z]{2}", accept=_state, needs="[a-z],? [A-Z][A-Z]"),
    Pattern("NUMERIC_PII", r"[A-Z]{1,4}-?[0-9]{5,}", accept=standalone, needs=_DIGIT),
    Pattern(
        "NUMERIC_VALUE",
        r"[0-9]++(?:[.,][0-9]++)*+",
        model.SCORE_BARE_NUMBER,
        accept=standalone,
        needs=_DIGIT,
    ),
    _contextual("US_BANK_NUMBER", "account|acct[.]?", "[0-9]{6,17}"),
    _contextual("US_ROUTING_TRANSIT_NUMBER", "routing|aba", "[0-9]{9}", _aba),
    _contextual(
        "CC_EXP",
        "exp(?:iry|iration|ires|[.])?(?: date)?",
        r"(?:0[1-9]|1[0-2])[/-](?:20)?[0-9]{2}",
    ),
    _contextual("CVV", "cv[cv]2?|security code", "[0-9]{3,4}"),
    Pattern(
        "CVV",
        rf"{_SPELLED}(?: {_SPELLED}){{2,3}}",
        model.SCORE_CONTEXT,
        prefix=rf"(?i:cv[cv]2?|security code){_IS}",
        accept=standalone,
        needs=("cvv", "cvc", "CVV", "CVC", "security code", "Security code"),
    ),
    Pattern(
        "PASSWORD",
        r"[^ \t\r\n\"',;]{4,}",
        model.SCORE_CONTEXT,
        prefix=rf"(?i:password|passwd|pwd)(?: is|[ ]?[:=]){_IS}",
        needs=("assw", "ASSW", "pwd", "PWD"),
    ),
    Pattern(
        "USERNAME",
        "[A-Za-z0-9_.-]{3,}",
        model.SCORE_CONTEXT,
        prefix=rf"(?i:user[ ]?name|userid|login)(?: is|[ ]?[:=]){_IS}",
        needs=("user", "User", "USER", "login", "Login", "LOGIN"),
    ),
    _contextual(
        "HEALTHCARE_ID",
        "mrn|medical record|member|patient|medicare|npi",
        "[A-Z0-9]{0,4}[0-9]{5,12}",
    ),
    _contextual("US_PASSPORT", "passport", "[A-Z]?[0-9]{8,9}"),
    _contextual("MEDICAL_LICENSE", "medical licen[cs]e|dea", "[A-Z]{1,2}[0-9]{6,8}"),
    _contextual("US_DRIVER_LICENSE", "driver'?s? licen[cs]e", "[A-Z]?[0-9]{5,12}"),
]

#: None of the above matches a line end or looks past one.
BUILTIN = [replace(p, in_line=True) for p in _BUILTIN]


def builtin(labels: Iterable[str] | None = None) -> list[Pattern]:
    wanted = None if labels is None else set(labels)
    return [p for p in BUILTIN if wanted is None or p.label in wanted]


# --- user rules ---------------------------------------------------------------------


def rules(
    by_label: Mapping[str, Sequence[str]] | None, score: float = model.SCORE_USER_RULE
) -> list[Pattern]:
    """Allow lists and custom entity types: matching text becomes that label."""
    return [
        Pattern(label, regex, score)
        for label, regexes in (by_label or {}).items()
        for regex in regexes
    ]


def requested_rules(
    defined: Mapping[str, Sequence[str]] | None, requested: Iterable[str] | None
) -> list[Pattern]:
    """Custom entity types are used only when the request names them."""
    defined = defined or {}
    missing = [name for name in requested or [] if name not in defined]
    if missing:
        raise ValueError(f"Unknown custom entities: {', '.join(missing)}")
    return rules({name: defined[name] for name in requested or []})


#: Largest word list compiled into a plan; longer ones go through the gazetteer join.
MAX_INLINE_TERMS = 1000


def dictionary(label: str, terms: Sequence[str], ignore_case: bool = False) -> Pattern:
    """Single-word dictionary: capitalised (or any) words looked up in a hash set."""
    if len(terms) > MAX_INLINE_TERMS:
        raise ValueError("word list too long for a plan: use the gazetteer instead")
    keys = [t.lower() if ignore_case else t for t in terms]

    def known(value: Sql, before: Sql, after: Sql) -> Sql:
        return (fn.lower(value) if ignore_case else value).isin(keys)

    return Pattern(
        label,
        r"[\p{L}]+" if ignore_case else r"\p{Lu}[\p{L}]*",
        model.SCORE_DICTIONARY,
        accept=known,
        in_line=True,
    )


def default_dictionaries() -> list[Pattern]:
    """Names and places the generators know; a real job brings its own lists."""
    return [
        dictionary("NAME_GIVEN", pools.MALE_NAMES + pools.FEMALE_NAMES),
        dictionary("NAME_FAMILY", pools.FAMILY_NAMES),
        dictionary("LOCATION_CITY", pools.CITIES),
    ]


def detect(
    text: Sql | str,
    patterns: Sequence[Pattern],
    block: Mapping[str, Sequence[str]] | None = None,
) -> Sql:
    """Spans of ``text`` as one expression, without overlaps."""
    text = named(text)

    def found_in(safe: Sql) -> Sql:
        found = candidates(safe, list(patterns))
        if block:
            found = without_blocked(found, candidates(safe, rules(block)))
        return resolve(found)

    spans = to_spans(let(mark_safe(text), found_in), text)
    return when(text.is_not_null(), spans)


def with_spans(
    df: DataFrame,
    patterns: Sequence[Pattern],
    text: str = "text",
    out: str = "spans",
    block: Mapping[str, Sequence[str]] | None = None,
    language: str | None = None,
    extra: str | None = None,
    overlaps: bool = False,
) -> DataFrame:
    """``df`` plus the spans of ``text``: an array of ``SPAN``, null for a null text.

    The same work as ``detect``, one projection per step: Spark analyses short
    expressions much faster than one deep one.  ``extra`` names a column of spans found
    elsewhere (a gazetteer join, a user's model); they take part in blocking and overlap
    resolution like any other.
    """
    patterns = list(patterns)
    safe, cuts, found = col("_vf_safe"), col("_vf_cuts"), col("_vf_found")
    step = df.withColumn("_vf_safe", mark_safe(col(text)).column())
    if patterns:
        step = step.withColumn("_vf_cuts", cuttings(safe, patterns).column())
        located_now = located(cuts, patterns)
    else:
        step = step.withColumn("_vf_cuts", empty("string").column())
        located_now = empty(CANDIDATE)
    if extra is not None:
        supplied = fn.coalesce(to_candidates(col(extra)), empty(CANDIDATE))
        located_now = fn.concat(located_now, supplied)
    step = step.withColumn("_vf_found", located_now.column())
    if block:
        blocked = rules(block)
        step = step.withColumn("_vf_blocked", candidates(safe, blocked).column())
        step = step.withColumn(
            "_vf_found", without_blocked(found, col("_vf_blocked")).column()
        ).drop("_vf_blocked")
    kept = fn.array_sort(found) if overlaps else resolve(found)
    step = step.withColumn("_vf_found", kept.column())
    spans = to_spans(found, col(text), col(language) if language else None)
    return step.withColumn(
        out, when(col(text).is_not_null(), spans).column()
    ).drop("_vf_safe", "_vf_cuts", "_vf_found")


def known_entities(
    text: Sql,
    spans: Sql,
    language: Sql | None = None,
    overlaps: bool = False,
) -> Sql:
    """Caller-supplied spans, cut to the text and made disjoint."""
    inside = fn.filter(
        spans, lambda s: (s["start"] >= 0) & (s["end"] <= fn.length(text))
    )
    kept = to_candidates(inside)
    kept = fn.array_sort(kept) if overlaps else resolve(kept)
    return to_spans(kept, text, language)


def whole_value(value: Sql, label: str) -> Sql:
    """Structured values: no detection, the whole value is the entity."""
    return when(
        fn.length(value) > 0,
        fn.array(
            struct(
                start=lit(0),
                end=fn.length(value),
                label=lit(label),
                text=value,
                score=lit(model.SCORE_PATH_RULE),
                language=lit(None).cast("string"),
                path=lit(None).cast("string"),
            )
        ),
    )


__all__ = [
    "BUILTIN",
    "aba_valid",
    "builtin",
    "default_dictionaries",
    "detect",
    "dictionary",
    "iban_valid",
    "known_entities",
    "luhn_valid",
    "requested_rules",
    "rules",
    "whole_value",
    "with_spans",
]
