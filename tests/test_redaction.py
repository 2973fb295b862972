"""Detection, states, tokens, synthesis on literal texts."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.invariants import TOKEN, check_redaction
from veilframe.functions.spans import MARK
from veilframe.functions.sql import col
from veilframe.functions.synth import synthesize
from veilframe.operators import vault
from veilframe.operators.detect import builtin, default_dictionaries, dictionary, with_spans
from veilframe.operators.redact import redact_frame
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

NAMES = [
    dictionary("NAME_GIVEN", ["Adam", "John", "Luke", "Alice", "Wilson"]),
    dictionary("NAME_GIVEN", ["adam"], ignore_case=True),
    dictionary("NAME_FAMILY", ["McFee", "Doe", "Smith", "Jones"]),
    dictionary("LOCATION_CITY", ["Tulsa", "Omaha"]),
    dictionary("LOCATION_COUNTRY", ["Japan"]),
]


def run(spark, texts, policy, dictionaries=NAMES):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = redact_frame(df, policy, "text", "id", dictionaries).orderBy("id").collect()
    for row in rows:
        if row.text is not None:
            check_redaction(row.text, row.redacted_text, row.spans)
    return rows


def labels(row):
    return {s.label: s.text for s in row.spans}


def test_compressed_addresses(spark):
    cases = {
        "at 2001:db8::1 and fe80::1": ["2001:db8::1", "fe80::1"],
        "ping ::1.": ["::1"],
        "[::1]:80 node:fe80::2%eth0": ["::1", "fe80::2"],
        "net 2001:db8::/32": ["2001:db8::"],
        "mapped ::ffff:192.0.2.1, plain 192.0.2.1": ["::ffff:192.0.2.1", "192.0.2.1"],
        "1::2::3 12345::1 1:2:3:4:5:6:7:8:9 12:30:45 00:1a:2b:3c:4d:5e std::deque a::operator": [],
        "1:" * 200_000 + " " + "a::b:" * 100_000: [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, text string")
    for row in with_spans(df, builtin(["IP_ADDRESS"])).collect():
        assert [s.text for s in row.spans] == cases[row.text]


def test_builtin_labels(spark):
    cases = {
        "mail a.b@x.com now": ("EMAIL_ADDRESS", "a.b@x.com"),
        "see https://a.b/c?d=1.": ("URL", "https://a.b/c?d=1"),
        "ip 192.168.123.132.": ("IP_ADDRESS", "192.168.123.132"),
        "ip 2001:0db8:0:0:0:ff00:42:8329": ("IP_ADDRESS", "2001:0db8:0:0:0:ff00:42:8329"),
        "call (123) 456-7890.": ("PHONE_NUMBER", "(123) 456-7890"),
        "call +1 (405) 555-0142": ("PHONE_NUMBER", "+1 (405) 555-0142"),
        "card 5555-5555-1111-2223,": ("CREDIT_CARD", "5555-5555-1111-2223"),
        "ssn 187-65-4321": ("US_SSN", "187-65-4321"),
        "itin 912-70-1234": ("US_ITIN", "912-70-1234"),
        "GB82 WEST 1234 5698 7654 32": ("IBAN_CODE", "GB82 WEST 1234 5698 7654 32"),
        "routing number 021000021": ("US_ROUTING_TRANSIT_NUMBER", "021000021"),
        "account 123456789": ("US_BANK_NUMBER", "123456789"),
        "x ⑆021000021⑆ y": ("MICR_CODE", "⑆021000021⑆"),
        "expires 09/25": ("CC_EXP", "09/25"),
        "cvv is four one nine": ("CVV", "four one nine"),
        "cvv: 419": ("CVV", "419"),
        "Boise, ID. 83702.": ("LOCATION_ZIP", "83702"),
        "due $12,000": ("MONEY", "$12,000"),
        "on 08-13-2024.": ("DATE_TIME", "08-13-2024"),
        "on March 27, 2024": ("DATE_TIME", "March 27, 2024"),
        "born on 01/02/1980": ("DOB", "01/02/1980"),
        "she was 61 years old then": ("PERSON_AGE", "61"),
        "My ID is 123": ("NUMERIC_VALUE", "123"),
        "ref AB123456": ("NUMERIC_PII", "AB123456"),
        "password: hunter2!": ("PASSWORD", "hunter2!"),
        "username is jdoe_1": ("USERNAME", "jdoe_1"),
        "MRN 12345678": ("HEALTHCARE_ID", "12345678"),
        "passport number A12345678": ("US_PASSPORT", "A12345678"),
        "medical license AB123456": ("MEDICAL_LICENSE", "AB123456"),
        "driver's license D1234567": ("US_DRIVER_LICENSE", "D1234567"),
    }
    rows = run(spark, list(cases), Policy())
    for row in rows:
        label, text = cases[row.text]
        assert labels(row).get(label) == text, (row.text, labels(row))
        assert text not in row.redacted_text
    assert {p.label for p in builtin()} >= {v[0] for v in cases.values()}


def test_off_default_and_strings(spark):
    text = (
        "Printer 10.20.30.40 was moved to the third floor; ask its new keeper "
        "Alice Oldershaw, who came over from Lisbon, before you restart it."
    )
    (row,) = run(spark, [text], Policy(default="Off", config={"NAME_GIVEN": "Redaction"}))
    assert "Alice" not in row.redacted_text
    assert "Oldershaw" in row.redacted_text and "Lisbon" in row.redacted_text
    assert [s.label for s in row.spans] == ["NAME_GIVEN"]
    assert row.usage == len(text.split())


def test_off_labels_keep_their_text(spark):
    (row,) = run(spark, ["call (123) 456-7890 x 77"], Policy(config={"PHONE_NUMBER": "Off"}))
    assert "(123) 456-7890" in row.redacted_text and "77" not in row.redacted_text
    loose = Policy(config={"PHONE_NUMBER": "Off"}, claim_off=False)
    (row,) = run(spark, ["call (123) 456-7890 x 77"], loose)
    assert "456" not in row.redacted_text


def test_null_empty_emoji_and_marks(spark):
    texts = [None, "", "🙏 Alice 🙏🏼 is 🌮12🌮", f"a{MARK}7 b 🤤 a@b.co{MARK}"]
    rows = run(spark, texts, Policy())
    assert rows[0].redacted_text is None and rows[0].spans is None
    assert rows[1].redacted_text == "" and rows[1].spans == []
    assert [s.text for s in rows[2].spans] == ["Alice", "12"]
    assert [s.text for s in rows[3].spans] == ["7", "a@b.co"]


def test_tokens_seeds_and_unredact(spark):
    texts = ["John met John Doe", "adam writes to a@b.co"]
    one = run(spark, texts, Policy(seed=1))
    again = run(spark, texts, Policy(seed=1))
    two = run(spark, texts, Policy(seed=2))
    assert [r.redacted_text for r in one] == [r.redacted_text for r in again]
    assert [r.redacted_text for r in one] != [r.redacted_text for r in two]
    assert one[0].spans[0].new_text == one[0].spans[1].new_text
    assert all(TOKEN.fullmatch(s.new_text) for r in one for s in r.spans)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    done = redact_frame(df, Policy(seed=1), "text", "id", NAMES)
    store = vault.vault_of(done)
    plus = done.select("id", F.concat("redacted_text", F.lit(" [NAME_GIVEN_0123456789abcdef]")).alias("redacted_text"))
    back = {r.id: r.unredacted_text for r in vault.unredact(plus, store, "id").collect()}
    assert back == {i: t + " [NAME_GIVEN_0123456789abcdef]" for i, t in enumerate(texts)}
    assert vault.collisions(store).count() == 0
    assert vault.merge_vault(store, store).count() == store.count()
    same = vault.unredact(plus, store, "id", broadcast=False).collect()
    assert {r.id: r.unredacted_text for r in same} == back


def test_allow_block_and_custom(spark):
    text = "Wilson has Wilson Disease, and my pet Rex lives in Dogtown"
    policy = Policy(
        allow={"NAME_GIVEN": ["Rex"], "LOCATION_CITY": ["Dogtown"]},
        block={"NAME_GIVEN": [r"Wilson\s(Disease|Syndrome|Condition)"]},
    )
    (row,) = run(spark, [text], policy)
    assert "Wilson Disease" in row.redacted_text
    assert [s.text for s in row.spans] == ["Wilson", "Rex", "Dogtown"]
    unnamed = Policy(custom={"PET": ["Rex"]})
    assert "Rex" in run(spark, [text], unnamed)[0].redacted_text
    named = Policy(custom={"PET": ["Rex"]}, custom_entities=["PET"])
    assert "[PET_" in run(spark, [text], named)[0].redacted_text
    with pytest.raises(ValueError):
        run(spark, [text], Policy(custom_entities=["NONE"]))


def test_policy_errors():
    with pytest.raises(ValueError, match="default state"):
        Policy(default="off").validate()
    with pytest.raises(ValueError, match="labels nobody knows"):
        Policy(config={"NOPE": "Off"}).validate()
    with pytest.raises(ValueError, match="unknown state"):
        Policy(config={"URL": "Invalid"}).validate()
    with pytest.raises(ValueError, match="options are given"):
        Policy(options={"NOPE": Options()}).validate()
    with pytest.raises(ValueError, match="takes NameOptions"):
        Policy(options={"NAME_GIVEN": Options()}).validate()
    assert Policy(options={"ORGANIZATION": Options(swaps={"a": "b"})}).validate()


def test_mixed_states(spark):
    text = (
        "Write to maria.jones@mill.org; Maria Jones, born on May 3, 1971, moved to Omaha, NE "
        "68102 and answers 555-987-6543."
    )
    policy = Policy(
        config={
            "NAME_GIVEN": "Off",
            "LOCATION_CITY": "GroupingSynthesis",
            "LOCATION_STATE": "ReplacementSynthesis",
            "EMAIL_ADDRESS": "Synthesis",
            "PHONE_NUMBER": "Off",
            "DOB": "GroupingSynthesis",
        },
        options={"LOCATION_STATE": AddressOptions(non_hipaa=True)},
        seed=42,
    )
    (row,) = run(spark, [text], policy)
    out = row.redacted_text
    assert "Maria" in out and "555-987-6543" in out
    assert "[NAME_FAMILY_" in out and "Jones" not in out
    assert "[LOCATION_ZIP_" in out
    assert "maria.jones@mill.org" not in out and "[EMAIL_ADDRESS_" not in out
    assert "Omaha" not in out and "[LOCATION_CITY_" not in out
    assert ", NE" not in out and "[LOCATION_STATE_" not in out
    assert "May 3, 1971" not in out and "[DOB_" not in out


def test_grouped_synthesis_uses_the_representative(spark):
    people = [dictionary("PERSON", ["Smith"]), *NAMES]
    policy = Policy(
        default="GroupingSynthesis", allow={"PERSON": ["John Smith", "Mr[.] Smith"]}, seed=3
    )
    (row,) = run(spark, ["John Smith works. Mr. Smith lives."], policy, people)
    assert row.spans[0].new_text == row.spans[1].new_text


# --- synthesis ------------------------------------------------------------------------


def synth(spark, label, values, options=None, seed=42, document=None):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    new = synthesize(col("v"), label, options, seed, document)
    return [r[0] for r in df.orderBy("id").select(new.column()).collect()]


def test_names(spark):
    upper, lower = synth(spark, "NAME_GIVEN", ["Adam", "adam"])
    assert upper.lower() == lower.lower() != "adam"
    strict = synth(spark, "NAME_GIVEN", ["Adam", "adam"], NameOptions(case_sensitive=True))
    assert strict[0].lower() != strict[1].lower()
    from veilframe.pools import FEMALE_NAMES

    kept = synth(spark, "NAME_GIVEN", ["Hannah", "Irene"], NameOptions(preserve_gender=True))
    assert all(k in FEMALE_NAMES for k in kept)


def test_emails(spark):
    values = ["john@example.com", "jane@company.org"]
    kept = synth(spark, "EMAIL_ADDRESS", values, EmailOptions(preserve_domain=True))
    assert kept[0].endswith("@example.com") and kept[1].endswith("@company.org")
    assert kept[0] != values[0]
    assert kept == synth(spark, "EMAIL_ADDRESS", values, EmailOptions(preserve_domain=True))
    assert not synth(spark, "EMAIL_ADDRESS", values)[0].endswith("@example.com")


def test_phones(spark):
    bad = "no number given here"
    for replace_invalid in (True, False):
        for us in (True, False):
            options = PhoneOptions(us_format=us, replace_invalid=replace_invalid)
            (new,) = synth(spark, "PHONE_NUMBER", [bad], options)
            assert new.isdigit() == (us and replace_invalid)
            assert new != bad
    options = PhoneOptions(us_format=True, preserve_area_code=True)
    (new,) = synth(spark, "PHONE_NUMBER", ["+1 (405) 555-0142"], options)
    assert re.fullmatch(r"\+1 \(405\) \d{3}-\d{4}", new) and new != "+1 (405) 555-0142"


def test_dates(spark):
    texts = [
        "Signed 02-05-2023, shipped 02-09-23, paid 02-17-2023; the next order came 03-27-2023."
    ]
    policy = Policy(
        default="Off",
        config={"DATE_TIME": "Synthesis"},
        options={"DATE_TIME": DateOptions(constant_shift=True)},
    )
    (row,) = run(spark, texts, policy)
    forms = ["%m-%d-%Y", "%m-%d-%y", "%m-%d-%Y", "%m-%d-%Y"]
    days = [datetime.strptime(s.new_text, f) for s, f in zip(row.spans, forms)]
    assert [(d - days[0]).days for d in days] == [0, 4, 12, 50]
    (new,) = synth(
        spark, "DATE_TIME", ["11xx04xx2021"], DateOptions(extra_formats=["dd'xx'MM'xx'yyyy"])
    )
    match = re.fullmatch(r"(\d{2})xx(\d{2})xx(\d{4})", new)
    assert 1 <= int(match[1]) <= 15 and match[2] == "04" and match[3] == "2021"
    (new,) = synth(spark, "DATE_TIME", ["2019|11|08"], DateOptions(extra_formats=["%Y|%m|%d"]))
    assert re.fullmatch(r"2019\|1[01]\|\d\d", new)
    far = synth(spark, "DATE_TIME", ["08-13-2024"], DateOptions(left_days=9000, right_days=10000))
    assert datetime.strptime(far[0], "%m-%d-%Y").year > 2024
    kept = synth(spark, "DATE_TIME", ["someday"], DateOptions(scramble_unrecognized=False))
    assert kept == ["someday"]
    assert synth(spark, "DATE_TIME", ["someday"]) != ["someday"]
    old = synth(
        spark, "DOB", ["03/04/1920", "03/04/1990"], DateOptions(group_year=True, as_of_year=2024)
    )
    assert old == ["01/01/1934", "01/01/1990"]
    formats = ["2024-02-28 10:22", "20240228", "28/Feb/2024", "May 1, 2024", "02-2024", "2/8/2024"]
    new = synth(spark, "DATE_TIME", formats)
    shape = [re.sub(r"[A-Za-z]+", "A", re.sub(r"\d+", "9", f)) for f in formats]
    assert [re.sub(r"[A-Za-z]+", "A", re.sub(r"\d+", "9", n)) for n in new] == shape


def test_ages(spark):
    (new,) = synth(spark, "PERSON_AGE", ["38"])
    assert 31 <= int(new) <= 45
    (new,) = synth(spark, "PERSON_AGE", ["97"], AgeOptions(shift_years=5))
    assert 92 <= int(new) <= 102
    grouped = synth(spark, "PERSON_AGE", ["89", "97"], AgeOptions(pass_through_to_89=True))
    assert grouped == ["89", "90+"]


def test_addresses(spark):
    assert synth(spark, "LOCATION_STATE", ["GA"]) == ["GA"]
    assert synth(spark, "LOCATION_STATE", ["GA"], AddressOptions(non_hipaa=True)) != ["GA"]
    (new,) = synth(spark, "LOCATION_ZIP", ["83702"])
    assert new.startswith("837") and not new.endswith("00") and len(new) == 5
    zeros = synth(spark, "LOCATION_ZIP", ["83702"], AddressOptions(replace_truncated_zeros=False))
    assert zeros == ["83700"]
    assert synth(spark, "LOCATION_ZIP", ["83702"], AddressOptions(three_digit_zips=True)) == ["837"]
    foreign = synth(spark, "LOCATION_ZIP", ["SW1A 2AA"], AddressOptions(foreign_zeros=True))
    assert foreign == ["0000 000"]
    (new,) = synth(spark, "LOCATION_CITY", ["AtLaNtA"], AddressOptions(realistic=False))
    assert [c.isupper() for c in new] == [c.isupper() for c in "AtLaNtA"] and new != "AtLaNtA"


def test_numbers_swaps_constants(spark):
    (new,) = synth(spark, "NUMERIC_VALUE", ["123"])
    assert len(new) == 3 and new.isdigit() and new != "123"
    (new,) = synth(spark, "NUMERIC_VALUE", ["123"], NumericOptions(integer_key=True))
    assert len(new) > 10 and new.isdigit()
    assert synth(spark, "ORGANIZATION", ["Acme"], Options(swaps={"Acme": "Contoso"})) == ["Contoso"]
    both = Options(swaps={"Acme": "Contoso"}, constant=True)
    assert synth(spark, "ORGANIZATION", ["Acme", "x"], both) == ["Contoso", "True"]
    assert synth(spark, "NRP", [None]) == [None]


def test_extra_spans_and_language(spark):
    df = spark.createDataFrame(
        [(1, "Ada met 42", "en", [(0, 3, "NAME_GIVEN", "Ada", 0.8)])],
        "id int, text string, lang string, found array<struct<start:int,end:int,label:string,text:string,score:double>>",
    )
    (row,) = with_spans(df, builtin(), language="lang", extra="found").collect()
    assert [(s.text, s.label, s.language) for s in row.spans] == [
        ("Ada", "NAME_GIVEN", "en"),
        ("42", "NUMERIC_VALUE", "en"),
    ]
    assert default_dictionaries()
