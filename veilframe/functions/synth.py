"""Synthesis: realistic, consistent, keyed stand-ins for sensitive values.

Every function maps a value column to its replacement with built-in expressions; the
replacement depends on (seed, generator, version, value) only, so it is the same in every
row, partition, retry and run.
"""

from __future__ import annotations

from collections.abc import Sequence


from .. import pools
from ..options import (
    AddressOptions,
    AgeOptions,
    DateOptions,
    EmailOptions,
    NameOptions,
    NumericOptions,
    Options,
    PhoneOptions,
    default_options,
    generator_of,
)
from .arrays import chars, indices, let
from .hashing import keyed_hex, keyed_int
from .sql import Sql, fn, lit, struct, when

Seed = int | str | None


def pick(pool: Sequence[str], at: Sql) -> Sql:
    entries = fn.split(lit("|".join(pool)), "[|]")
    return fn.element_at(entries, (at + 1).cast("int"))


def pick_other(pool: Sequence[str], at: Sql, value: Sql) -> Sql:
    """Pool entry chosen by ``at``; the next one when it equals the original."""
    return let(
        at,
        lambda i: let(
            pick(pool, i),
            lambda chosen: when(
                fn.lower(chosen) == fn.lower(value), pick(pool, (i + 1) % len(pool))
            ).otherwise(chosen),
        ),
    )


def like_case(new: Sql, value: Sql) -> Sql:
    return (
        when(value == fn.lower(value), fn.lower(new))
        .when((value == fn.upper(value)) & (fn.length(value) > 1), fn.upper(new))
        .otherwise(new)
    )


def scramble(value: Sql, seed: Seed, purpose: str = "Scramble") -> Sql:
    """Replace every letter and digit by another of its class, punctuation kept.

    The shift of each ASCII character is never zero, so the result differs from the
    input wherever the input has a letter or digit.
    """
    blocks = fn.transform(
        indices(fn.length(value), 16), lambda k: keyed_hex(seed, purpose, value, k.cast("string"))
    )

    def change(c: Sql, r: Sql) -> Sql:
        code = fn.ascii(c)
        return (
            when(c.rlike("[0-9]"), fn.char((code - 48 + 1 + r % 9) % 10 + 48))
            .when(c.rlike("[A-Z]"), fn.char((code - 65 + 1 + r % 25) % 26 + 65))
            .when(c.rlike("[a-z]"), fn.char((code - 97 + 1 + r % 25) % 26 + 97))
            .when(c.rlike(r"\p{Lu}"), fn.char(r % 26 + 65))
            .when(c.rlike(r"\p{L}"), fn.char(r % 26 + 97))
            .otherwise(c)
        )

    def build(v: Sql) -> Sql:
        changed = fn.transform(
            v["cs"],
            lambda c, i: change(
                c,
                fn.conv(fn.substring(v["stream"], i * 4 + 1, lit(4)), 16, 10).cast("int"),
            ),
        )
        return fn.array_join(changed, "")

    return let(struct(cs=chars(value), stream=fn.array_join(blocks, "")), build)


def name(value: Sql, kind: str, options: NameOptions, seed: Seed) -> Sql:
    key = value if options.case_sensitive else fn.lower(value)
    purpose = f"Name{options.version}{'G' if options.preserve_gender else ''}"

    def given() -> Sql:
        everyone = pools.MALE_NAMES + pools.FEMALE_NAMES
        anyone = pick_other(
            everyone, keyed_int(seed, purpose, len(everyone), key), value
        )
        if not options.preserve_gender:
            return anyone
        result = anyone
        for pool in (pools.MALE_NAMES, pools.FEMALE_NAMES):
            same = pick_other(pool, keyed_int(seed, purpose, len(pool), key), value)
            member = fn.lower(value).isin([n.lower() for n in pool])
            result = when(member, same).otherwise(result)
        return result

    def family() -> Sql:
        size = len(pools.FAMILY_NAMES)
        at = keyed_int(seed, purpose + "Family", size, key)
        return pick_other(pools.FAMILY_NAMES, at, value)

    if kind == "NAME_FAMILY":
        new = family()
    elif kind == "PERSON":
        new = fn.concat_ws(" ", given(), family())
    else:
        new = given()
    return like_case(new, value)


def email(value: Sql, options: EmailOptions, seed: Seed) -> Sql:
    local = fn.regexp_extract(value, "^([^@]*)", 1)
    domain = fn.regexp_extract(value, "@(.*)$", 1)
    new_local = scramble(local, seed, "EmailLocal" + options.version)
    if options.preserve_domain:
        new_domain = domain
    else:
        ending = fn.regexp_extract(domain, "([.][^.]*)$", 1)
        host = fn.regexp_replace(domain, "[.][^.]*$", "")
        new_domain = fn.concat(
            scramble(host, seed, "EmailDomain" + options.version), ending
        )
    return when(
        fn.contains(value, lit("@")), fn.concat(new_local, lit("@"), new_domain)
    ).otherwise(scramble(value, seed, "EmailLocal" + options.version))


def put_digits(template: Sql, digits: Sql) -> Sql:
    """``template`` with its digits replaced, right-aligned, by those of ``digits``."""

    def build(v: Sql) -> Sql:
        total = fn.length(fn.regexp_replace(v["t"], "[^0-9]", ""))
        cs = chars(v["t"])
        placed = fn.transform(
            cs,
            lambda c, i: when(
                c.rlike("[0-9]"),
                let(
                    fn.length(v["d"])
                    - total
                    + fn.length(
                        fn.regexp_replace(fn.substring(v["t"], lit(1), i), "[^0-9]", "")
                    ),
                    lambda at: when(
                        at >= 0, fn.substring(v["d"], at + 1, lit(1))
                    ).otherwise(c),
                ),
            ).otherwise(c),
        )
        return fn.array_join(placed, "")

    return let(struct(t=template, d=digits), build)


def phone(value: Sql, options: PhoneOptions, seed: Seed) -> Sql:
    purpose = "Phone" + options.version
    digits = fn.regexp_replace(value, "[^0-9]", "")
    valid = value.rlike("^[+]?[0-9() .-]+$") & fn.length(digits).between(7, 15)
    if not options.us_format:
        country = fn.regexp_extract(value, "^([+][0-9]{1,3})[ (.-]", 1)
        rest = fn.substring(value, fn.length(country) + 1, fn.length(value))
        shifted = fn.concat(country, scramble(rest, seed, purpose))
        return when(valid, shifted).otherwise(scramble(value, seed, purpose))

    def part(which: str, low: int, size: int) -> Sql:
        return keyed_int(seed, purpose + which, size, value) + low

    area = fn.lpad(part("Area", 200, 800).cast("string"), 3, "0")
    if options.preserve_area_code:
        area = when(
            fn.length(digits) >= 10, fn.substring(fn.right(digits, lit(10)), 1, 3)
        ).otherwise(area)
    us = fn.concat(
        area,
        part("Exchange", 200, 800).cast("string"),
        fn.lpad(part("Line", 0, 10000).cast("string"), 4, "0"),
    )
    invalid = us if options.replace_invalid else scramble(value, seed, purpose)
    return when(valid, put_digits(value, us)).otherwise(invalid)


# Recognised date forms (shape, pattern), the first that fits wins.
_D2, _D12, _Y4, _Y2 = "[0-9]{2}", "[0-9]{1,2}", "[0-9]{4}", "[0-9]{2}"
_MM = "(?:0[1-9]|1[0-2])"
_LONG = "(?:May|[A-Za-z]{4,9})"
DATE_FORMS = [
    (rf"^{_Y4}-{_D2}-{_D2}$", "yyyy-MM-dd"),
    (rf"^{_Y4}-{_D2}-{_D2} {_D2}:{_D2}$", "yyyy-MM-dd HH:mm"),
    (rf"^{_Y4}-{_D2}-{_D2} {_D2}:{_D2}:{_D2}$", "yyyy-MM-dd HH:mm:ss"),
    (rf"^{_Y4}-{_D2}-{_D2}T{_D2}:{_D2}$", "yyyy-MM-dd'T'HH:mm"),
    (rf"^{_Y4}-{_D2}-{_D2}T{_D2}:{_D2}:{_D2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (rf"^(?:19|20){_D2}{_MM}{_D2}$", "yyyyMMdd"),
    (rf"^{_MM}{_D2}{_Y4}$", "MMddyyyy"),
    (rf"^{_MM}/{_D2}/{_Y4}$", "MM/dd/yyyy"),
    (rf"^{_D2}/{_MM}/{_Y4}$", "dd/MM/yyyy"),
    (rf"^{_MM}-{_D2}-{_Y4}$", "MM-dd-yyyy"),
    (rf"^{_D2}-{_MM}-{_Y4}$", "dd-MM-yyyy"),
    (rf"^{_MM}/{_D2}/{_Y2}$", "MM/dd/yy"),
    (rf"^{_MM}-{_D2}-{_Y2}$", "MM-dd-yy"),
    (rf"^{_D12}/{_D12}/{_Y4}$", "M/d/yyyy"),
    (rf"^{_D12}-{_D12}-{_Y4}$", "M-d-yyyy"),
    (rf"^{_D12}/{_D12}/{_Y2}$", "M/d/yy"),
    (rf"^{_D2}/[A-Za-z]{{3}}/{_Y4}$", "dd/MMM/yyyy"),
    (rf"^{_D2}-[A-Za-z]{{3}}-{_Y4}$", "dd-MMM-yyyy"),
    (rf"^{_D12} {_LONG} {_Y4}$", "d MMMM yyyy"),
    (rf"^{_D12} [A-Za-z]{{3}} {_Y4}$", "d MMM yyyy"),
    (rf"^{_LONG} {_D12}, {_Y4}$", "MMMM d, yyyy"),
    (rf"^[A-Za-z]{{3}} {_D12}, {_Y4}$", "MMM d, yyyy"),
    (rf"^{_LONG} {_D12} {_Y4}$", "MMMM d yyyy"),
    (rf"^[A-Za-z]{{3}} {_D12} {_Y4}$", "MMM d yyyy"),
    (rf"^{_MM}-{_Y4}$", "MM-yyyy"),
    (rf"^{_LONG} {_Y4}$", "MMMM yyyy"),
    (rf"^[A-Za-z]{{3}} {_Y4}$", "MMM yyyy"),
]

# Strftime codes and their pattern letters.
STRFTIME = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%b": "MMM",
    "%B": "MMMM",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
}


def pattern_of(form: str) -> str:
    """Accepts strftime codes as well as Java patterns."""
    if "%" in form:
        for code, letters in STRFTIME.items():
            form = form.replace(code, letters)
    return form


def day_shift(
    value: Sql, options: DateOptions, seed: Seed, document: Sql | None
) -> Sql:
    key = document.cast("string") if options.constant_shift and document is not None else value
    span = options.right_days - options.left_days + 1
    purpose = "Date" + options.version
    return (keyed_int(seed, purpose, span, key) + options.left_days).cast("int")


def grouped_year(day: Sql, as_of_year: int) -> Sql:
    """1 January; years 90 or more before ``as_of_year`` collapse into one."""
    year = when(as_of_year - fn.year(day) < 90, fn.year(day)).otherwise(as_of_year - 90)
    return fn.make_date(year, lit(1), lit(1))


def date(
    value: Sql, options: DateOptions, seed: Seed, document: Sql | None = None
) -> Sql:

    def moved(v: Sql, form: str) -> Sql:
        # the pattern is a literal in every branch: Spark then builds its formatter once
        parsed = fn.try_to_timestamp(v["value"], form)
        if options.group_year:
            new = grouped_year(parsed, options.as_of_year)
        elif "H" in form:
            new = parsed + fn.make_dt_interval(v["shift"])
        else:
            new = fn.date_add(parsed.cast("date"), v["shift"])
        return fn.date_format(new, form)

    def known_forms(v: Sql) -> Sql:
        extra = [moved(v, pattern_of(f)) for f in options.extra_formats]
        known = when(lit(False), "")
        for regex, form in DATE_FORMS:
            known = known.when(v["value"].rlike(regex), moved(v, form))
        return fn.coalesce(*extra, known)

    shift = day_shift(value, options, seed, document)
    known = let(struct(value=value, shift=shift), known_forms)
    fallback = (
        scramble(value, seed, "DateText" + options.version)
        if options.scramble_unrecognized
        else value
    )
    return fn.coalesce(known, fallback)


def age(value: Sql, options: AgeOptions, seed: Seed) -> Sql:
    years = fn.regexp_extract(value, "([0-9]+)", 1)
    has_number = value.rlike("[0-9]")
    number = fn.try_to_number(years, lit("999999999")).cast("int")
    if options.pass_through_to_89:
        new = when(number <= 89, years).otherwise(lit("90+"))
    else:
        k = options.shift_years
        moved = number + keyed_int(seed, "Age" + options.version, 2 * k + 1, value) - k
        new = fn.greatest(moved, lit(0)).cast("string")
    fallback = scramble(value, seed, "AgeText") if options.scramble_unrecognized else value
    # replace the first number only
    before = fn.regexp_extract(value, "^([^0-9]*)", 1)
    after = fn.regexp_extract(value, "^[^0-9]*[0-9]+((?s).*)$", 1)
    return when(has_number, fn.concat(before, new, after)).otherwise(fallback)


def zip_code(value: Sql, options: AddressOptions, seed: Seed) -> Sql:
    head = fn.substring(value, 1, 3)
    filler = fn.lpad((keyed_int(seed, "Zip" + options.version, 99, value) + 1).cast("string"), 2, "0")
    local = value.rlike("^[0-9]{5}(?:-[0-9]{4})?$")
    if options.three_digit_zips:
        new = head
    else:
        two = filler if options.replace_truncated_zeros else lit("00")
        plus_four = fn.substring(value, lit(6), lit(5))
        tail = (
            scramble(plus_four, seed, "ZipTail" + options.version)
            if options.replace_truncated_zeros
            else fn.regexp_replace(plus_four, "[0-9]", "0")
        )
        new = fn.concat(head, two, tail)
    foreign = (
        fn.regexp_replace(value, "[A-Za-z0-9]", "0")
        if options.foreign_zeros
        else scramble(value, seed, "ZipForeign" + options.version)
    )
    return when(local, new).otherwise(foreign)


def address(value: Sql, label: str, options: AddressOptions, seed: Seed) -> Sql:
    purpose = "Address" + options.version
    if label == "LOCATION_ZIP":
        return zip_code(value, options, seed)
    if label == "LOCATION_STATE":
        if not options.non_hipaa:
            return value
        at = keyed_int(seed, purpose + "State", len(pools.US_STATES), value)
        return pick_other(pools.US_STATES, at, value)
    if not options.realistic:
        return scramble(value, seed, purpose)
    key = fn.lower(value)
    city = pick_other(
        pools.CITIES, keyed_int(seed, purpose + "City", len(pools.CITIES), key), value
    )
    if label in ("LOCATION", "LOCATION_CITY"):
        return city
    number = (keyed_int(seed, purpose + "Number", 9900, key) + 100).cast("string")
    street = pick(pools.STREETS, keyed_int(seed, purpose + "Street", len(pools.STREETS), key))
    line = fn.concat_ws(" ", number, street, lit("Street"))
    if label == "LOCATION_ADDRESS":
        return line
    return fn.concat_ws(", ", line, city)


def numeric(value: Sql, options: NumericOptions, seed: Seed) -> Sql:
    if options.integer_key:
        return (
            keyed_int(seed, "IntegerKey" + options.version, 9 * 10**11, value) + 10**11
        ).cast("string")
    return scramble(value, seed, "Numeric" + options.version)


def company(value: Sql, seed: Seed) -> Sql:
    key = fn.lower(value)
    word = pick(pools.COMPANY_WORDS, keyed_int(seed, "Company", len(pools.COMPANY_WORDS), key))
    ending = pick(
        pools.COMPANY_ENDINGS, keyed_int(seed, "CompanyEnding", len(pools.COMPANY_ENDINGS), key)
    )
    return fn.concat_ws(" ", word, ending)


def ip_address(value: Sql, seed: Seed) -> Sql:
    octets = [
        (keyed_int(seed, f"Ip{i}", 254, value) + 1).cast("string") for i in range(4)
    ]
    return when(fn.contains(value, lit(":")), scramble(value, seed, "Ip6")).otherwise(
        fn.concat_ws(".", *octets)
    )


def url(value: Sql, seed: Seed) -> Sql:
    scheme = fn.regexp_extract(value, "^([a-z]+://|www[.])", 1)
    rest = fn.substring(value, fn.length(scheme) + 1, fn.length(value))
    return fn.concat(scheme, scramble(rest, seed, "Url"))


def card_expiry(value: Sql, seed: Seed) -> Sql:
    month = fn.lpad((keyed_int(seed, "ExpMonth", 12, value) + 1).cast("string"), 2, "0")
    sign = fn.regexp_extract(value, "([/-])", 1)
    year = fn.regexp_extract(value, "([0-9]+)$", 1)
    later = fn.lpad(
        (fn.try_to_number(year, lit("9999")).cast("int") + keyed_int(seed, "ExpYear", 4, value) + 1)
        .cast("string"),
        2,
        "0",
    )
    return when(
        value.rlike("^[0-9]{1,2}[/-][0-9]{2,4}$"), fn.concat(month, sign, later)
    ).otherwise(scramble(value, seed, "ExpText"))


def luhn_digit(payload: Sql) -> Sql:
    """Check digit that makes ``payload`` + digit pass the Luhn test."""
    backwards = fn.reverse(chars(payload))
    doubled = fn.transform(
        backwards,
        lambda c, i: let(
            c.cast("int") * when(i % 2 == 0, 2).otherwise(1),
            lambda d: when(d > 9, d - 9).otherwise(d),
        ),
    )
    total = fn.aggregate(doubled, lit(0), lambda acc, d: acc + d)
    return ((10 - total % 10) % 10).cast("string")


def credit_card(value: Sql, seed: Seed) -> Sql:
    def build(new: Sql) -> Sql:
        kept = fn.substring(new, lit(1), fn.length(new) - 1)
        return fn.concat(kept, luhn_digit(fn.regexp_replace(kept, "[^0-9]", "")))

    changed = let(scramble(value, seed, "Card"), build)
    return when(value.rlike("^[0-9](?:[ -]?[0-9])+$"), changed).otherwise(
        scramble(value, seed, "Card")
    )


def generate(
    value: Sql,
    label: str,
    options: Options | None,
    seed: Seed,
    document: Sql | None = None,
) -> Sql:
    """The generator of a label, without swaps and constants."""
    kind = generator_of(label, options)
    own = options if options is not None else default_options(label)
    if kind == "Name":
        return name(value, label, own if isinstance(own, NameOptions) else NameOptions(), seed)
    if kind == "Email":
        return email(value, own if isinstance(own, EmailOptions) else EmailOptions(), seed)
    if kind == "PhoneNumber":
        return phone(value, own if isinstance(own, PhoneOptions) else PhoneOptions(), seed)
    if kind == "DateTime":
        return date(
            value, own if isinstance(own, DateOptions) else DateOptions(), seed, document
        )
    if kind == "PersonAge":
        return age(value, own if isinstance(own, AgeOptions) else AgeOptions(), seed)
    if kind == "HipaaAddressGenerator":
        return address(
            value, label, own if isinstance(own, AddressOptions) else AddressOptions(), seed
        )
    if kind == "NumericValue":
        return numeric(
            value, own if isinstance(own, NumericOptions) else NumericOptions(), seed
        )
    if kind == "CompanyName":
        return company(value, seed)
    if kind == "IpAddress":
        return ip_address(value, seed)
    if kind == "Url":
        return url(value, seed)
    if kind == "CcExp":
        return card_expiry(value, seed)
    if kind == "CreditCard":
        return credit_card(value, seed)
    return scramble(value, seed, kind)


def synthesize(
    value: Sql,
    label: str,
    options: Options | None = None,
    seed: Seed = None,
    document: Sql | None = None,
) -> Sql:
    """Swap, else constant, else generated."""
    new = generate(value, label, options, seed, document)
    if options is not None:
        if options.constant is not None:
            new = lit(options.constant)
        if options.swaps:
            pairs = [lit(x) for pair in options.swaps.items() for x in pair]
            new = fn.coalesce(fn.element_at(fn.map(*pairs), value), new)
    return when(value.is_not_null(), new)
