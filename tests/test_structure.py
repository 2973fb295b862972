"""Markup, JSON, chunks, conversations, transcripts against brute force."""

import json
import random
import re

from pyspark.sql import functions as F

from tests.invariants import check_spans, reconstructed
from veilframe.functions.sql import col
from veilframe.operators import conversation, json_text, markup, ordered, transcript
from veilframe.operators.chunking import chunks, split_markdown
from veilframe.operators.detect import builtin, dictionary
from veilframe.operators.gazetteer import with_gazetteer
from veilframe.operators.redact import redact_frame
from veilframe.policy import Policy

PEOPLE = [
    dictionary("NAME_GIVEN", ["John", "Jim", "Lis"]),
    dictionary("NAME_FAMILY", ["Doe"]),
]

HTML = """<html>
 <head><title>John Doe</title></head>
 <body><h1>Personal</h1><!-- John <b> -->
  <p>My name is Jo<span class="x">hn</span> Doe and I am 22 years old.</p><br>
  <p>Mail <a href="mailto:jd@example.com">jd@example.com</a>.</p>
  <p>Call (123) 456-7890.</p><script>var t="</p> John";</script>
 </body></html>"""

XML = """<?xml version="1.0"?>
<!-- John Doe -->
<Info xmlns:c="http://www.example.com/c">
  <Name c:id="uid" k='v'><First>John</First><Last>Doe</Last></Name>
  <c:Mail address="john.doe@example.com"/><c:Phone number="555-6789"/>
  <SSN value="187-65-4321"/><data>his name was John Doe</data><data>Jim</data>
</Info>"""


def tags(text):
    return re.findall(r"</?[A-Za-z:]+", text)


def test_html(spark):
    df = spark.createDataFrame([(1, HTML), (2, ""), (3, None), (4, "plain 7")], "id int, html string")
    policy = Policy(config={"PHONE_NUMBER": "Off", "EMAIL_ADDRESS": "Off", "URL": "Off"})
    rows = markup.redact_markup(df, policy, "html", "id", dictionaries=PEOPLE).orderBy("id").collect()
    out = rows[0].redacted_text
    assert tags(out) == tags(HTML)
    assert "Jo<" not in out and "Doe" not in out and " 22 " not in out
    assert "(123) 456-7890" in out and out.count("jd@example.com") == 2
    assert 'var t="</p> John";' in out and "<!-- John <b> -->" in out
    assert {s.path for s in rows[0].spans} == {"/html[1]/head[1]/title[1]", "/html[1]/body[1]/p[1]"}
    assert [r.redacted_text for r in rows[1:3]] == ["", None]
    assert rows[3].redacted_text.startswith("plain [NUMERIC_VALUE_")


def test_xml(spark):
    df = spark.createDataFrame([(1, XML)], "id int, xml string")
    (row,) = markup.redact_markup(df, Policy(), "xml", "id", html=False, dictionaries=PEOPLE).collect()
    out = row.redacted_text
    body = out.split("-->")[1]
    for gone in ["John", "Doe", "Jim", "john.doe@example.com", "555-6789", "187-65-4321"]:
        assert gone not in body
    assert 'xmlns:c="http://www.example.com/c"' in out
    import xml.etree.ElementTree as tree

    tree.fromstring(out)
    paths = {s.text: s.path for s in row.spans}
    assert paths["187-65-4321"] == "/Info[1]/SSN[1]/@value"
    assert paths["Jim"] == "/Info[1]/data[2]"
    assert paths["555-6789"] == "/Info[1]/c:Phone[1]/@number"


DOC = {
    "person": {"first": "John", "last": 'Jo"hn\\son é'},
    "address": {"city": "Memphis", "zip": 12345, "ok": True, "n": None, "a b": "x"},
    "tags": ["a", {"k": "x@y.com"}, [1, 2.5e3]],
    "description": "John is a man in Memphis.\nHe is 37 years old",
}


def walk(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, path + (f".{k}" if re.fullmatch(r"[\w-]+", k) else f"['{k}']"))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")
    else:
        yield path, value


def test_json_leaves(spark):
    for text in [json.dumps(DOC), json.dumps(DOC, indent=2, ensure_ascii=False), "7", '"s"', "[]"]:
        df = spark.createDataFrame([(1, text)], "id int, json string")
        got = [(r.path, r.value) for r in json_text.explode_leaves(df, "json", "id").collect()]
        want = [
            (p, None if v is None else json.dumps(v) if not isinstance(v, str) else v)
            for p, v in walk(json.loads(text))
        ]
        fixed = [(p, "2.5e3" if v == "2500.0" and '2.5e3' in text else v) for p, v in want]
        assert got == want or got == fixed


def test_long_and_hostile_texts(spark):
    """Nothing recurses with the length of a text."""
    inner = json.dumps({"k": 'x"y\\' * 20000})
    text = json.dumps({"a": inner, "b": [inner, 'z@y.com']})
    df = spark.createDataFrame([(1, text)], "id int, json string")
    (row,) = json_text.redact_json(df, Policy(default="Off", config={"EMAIL_ADDRESS": "Redaction"}), "json", "id").collect()
    new = json.loads(row.redacted_text)
    assert new["a"] == inner and new["b"][0] == inner and new["b"][1].startswith("[EMAIL_")
    texts = [",".join("1" * 30000), "1." * 30000, "a@b" + ".c" * 30000, "<b " + "it's " * 30000, "a-" * 30000, "@" + "7" * 60000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in redact_frame(df, Policy(), "text", "id").collect():
        check_spans(row.text, row.spans)
        assert reconstructed(row.redacted_text, row.spans) == row.text
    rows = markup.redact_markup(df, Policy(), "text", "id").collect()
    assert len(rows) == 6
    gaz = spark.createDataFrame([("NRP", "a-a")], "label string, term string")
    assert with_gazetteer(df.withColumnRenamed("id", "doc_id"), gaz).count() == 6


def test_redact_json(spark):
    policy = Policy(
        config={"LOCATION_ZIP": "Synthesis"},
        path_allow={
            "LOCATION_ZIP": ["$.address.zip"],
            "ORGANIZATION": ["$.address.city"],
            "PHONE_NUMBER": ["$.person.*"],
        },
        path_ignore=["$.tags[*]", "$.tags[*][*]"],
    )
    text = json.dumps(DOC, indent=1)
    df = spark.createDataFrame([(1, text), (2, None)], "id int, json string")
    rows = json_text.redact_json(df, policy, "json", "id", PEOPLE).orderBy("id").collect()
    new = json.loads(rows[0].redacted_text)
    assert isinstance(new["address"]["zip"], int) and new["address"]["zip"] != 12345
    assert new["person"]["first"].startswith("[PHONE_NUMBER_")
    assert new["address"]["city"].startswith("[ORGANIZATION_")
    assert new["tags"][0] == "a" and new["tags"][2] == [1, 2500.0]
    assert "John" not in new["description"] and "37" not in new["description"]
    assert new["address"]["n"] is None and new["address"]["ok"] is True
    assert rows[1].redacted_text is None


def brute_split(text, limit):
    def cut(start, end, level, trail):
        body, last, parts = text[start:end], 0, []
        for m in re.finditer(rf"(?m)^#{{1,{level}}}\s+(.*)$", body):
            if m.start() > last:
                parts.append((last, m.start(), trail))
            trail, last = trail[: level - 1] + [m.group(1)], m.start()
        if last < len(body):
            parts.append((last, len(body), trail))
        for a, b, h in parts:
            if b - a <= limit:
                yield start + a, start + b, h
            elif level < 6:
                yield from cut(start + a, start + b, level + 1, h)
            else:
                at = a
                while at + limit < b:
                    newline = body.rfind("\n", at, at + limit)
                    stop = newline if newline > at else at + limit
                    yield start + at, start + stop, h
                    at = stop + 1 if newline > at else stop
                if at < b:
                    yield start + at, start + b, h

    return list(cut(0, len(text), 1, []))


def test_split_markdown(spark):
    rng = random.Random(5)
    bits = ["# A\n", "## B b\n", "### C\n", "#### D\n", "text ", "\n", "🌮", "x" * 7, "#\n", "###### Z\n", "#no\n"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    df = spark.createDataFrame(docs, "id int, text string")
    for limit in (5, 17, 40, 1000):
        rows = split_markdown(df, "text", limit).collect()
        for row in rows:
            got = [(s.start, s.end, list(s.headers)) for s in row.sections]
            assert got == brute_split(row.text, limit)


def test_chunks(spark):
    text = "# One\nmail a@b.co and a@b.co\n## Two\nip 1.2.3.4 end\n"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    policy = Policy(default="Off", config={"EMAIL_ADDRESS": "Redaction"})
    done = redact_frame(df, Policy(config={"IP_ADDRESS": "Off"}), "text", "doc_id")
    rows = (
        chunks(
            done, policy, max_chars=35, metadata_labels=["EMAIL_ADDRESS"], redacted="redacted_text"
        )
        .orderBy("chunk_no")
        .collect()
    )
    assert "".join(r.text for r in rows) == done.first().redacted_text
    assert rows[0].is_sensitive and rows[0].entities == {"EMAIL_ADDRESS": ["a@b.co"]}
    assert not rows[-1].is_sensitive
    assert rows[0].headers == ["One", "One"] and rows[-1].headers == ["One", "Two"]


def talk(spark, rows):
    return spark.createDataFrame(rows, "id string, ord int, text string")


def test_border_crossing(spark):
    policy = Policy(
        allow={"NAME_GIVEN": ["(?i)o\n?s\n?c\n?a\n?r", "Mia"], "LOCATION_CITY": ["Tulsa"]}
    )
    rows = [
        ("1", 0, "Mia wrote it down for os"),
        ("1", 1, "ca"),
        ("1", 2, "r who drove to Tulsa"),
        ("2", 7, "nobody here"),
        ("2", 9, None),
    ]
    done = conversation.redact_rows(talk(spark, rows), policy, ["id"], "ord").collect()
    by = {(r.id, r.ord): r for r in done}
    assert len(done) == 5 and all(r.usage == -1 for r in done)
    first, second, third = (by["1", i] for i in range(3))
    name = first.spans[1].new_text
    assert first.spans[1].text == second.spans[0].text == third.spans[0].text == "os\nca\nr"
    assert second.redacted_text == name
    assert third.redacted_text.startswith(name + " who drove to [LOCATION_CITY_")
    assert [(s.start, s.end) for s in third.spans] == [(0, 1), (15, 20)]
    for r in (first, second, third):
        for s in r.spans:
            assert r.redacted_text[s.new_start : s.new_end] == s.new_text
    assert by["2", 9].redacted_text is None


def test_groups_of_any_length(spark):
    rng = random.Random(9)
    rows = [("g", i * 3, " ".join(rng.choice(["ab", "c", "abc", "x"]) for _ in range(rng.randint(0, 6)))) for i in range(600)]
    rows[100] = ("g", 300, "START")
    rows[160] = ("g", 480, "STOP")
    allow = {"LAW": ["c\nab", "abc", r"START(?:\n[^\n]*){60}"]}
    policy = Policy(default="Off", config={"LAW": "Redaction"}, allow=allow, claim_off=False)
    done = conversation.redact_rows(talk(spark, rows), policy, ["id"], "ord").collect()
    done.sort(key=lambda r: r.ord)
    texts = [t for _, _, t in rows]
    joined = "\n".join(texts)
    starts = [sum(len(t) + 1 for t in texts[:i]) for i in range(len(texts))]
    found = [m for m in re.finditer("START(?:\n[^\n]*){60}|c\nab|abc", joined)]
    for row, (_, _, t), start in zip(done, rows, starts):
        want = [
            (max(m.start() - start, 0), min(m.end() - start, len(t)), m.group())
            for m in found
            if m.start() < start + len(t) and m.end() > start
        ]
        assert [(s.start, s.end, s.text) for s in row.spans] == want


def test_row_path_equals_group_path(spark, monkeypatch):
    texts = ["I am 38 y/o", "years old, at 10.1.2.3", None, "a.b@c.de", "", "card 5555-5555-1111-2223 x"]
    rows = [("g", i, t) for i, t in enumerate(texts)]
    df = talk(spark, rows)
    assert not conversation.needs_whole_group(builtin(), Policy())
    got = sorted(map(str, conversation.redact_rows(df, Policy(), ["id"], "ord").collect()))
    monkeypatch.setattr(conversation, "needs_whole_group", lambda *a: True)
    assert got == sorted(map(str, conversation.redact_rows(df, Policy(), ["id"], "ord").collect()))


def test_which_patterns_stay_in_a_line():
    stay = conversation.stays_in_line
    for regex in ["abc", r"[a-z]+ \d{2}", r"\p{Lu}[\p{L}]*", r"[^\n]*x", r"(?i:ab|c)", r"a.b", r"\[x\]"]:
        assert stay(regex), regex
    for regex in ["a\nb", r"a\nb", r"\s", r"[^a]", r"^a", r"a$", r"\bx", r"(?s:a.b)", r"(?<=a)b", r"\W", r"\p{P}"]:
        assert not stay(regex), regex
    assert not stay("abc", " ")


def test_prefix_sum_depths(spark):
    rng = random.Random(2)
    rows = [(g, o, rng.randint(0, 9)) for g in "ab" for o in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    for bits, depth in [(3, 2), (5, 1), (16, 2), (2, 3)]:
        got = {
            (r.g, r.o): r.p
            for r in ordered.prefix_sum(df, ["g"], "o", F.col("v"), "p", bits, depth).collect()
        }
        for g in "ab":
            total = 0
            for _, o, v in sorted(r for r in rows if r[0] == g):
                assert got[g, o] == total
                total += v


def test_transcript(spark):
    segment = "struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,word:string>>>"
    words1 = [(0.0, 1.0, "my"), (1.0, 2.0, "name"), (2.0, 3.0, "is"), (3.0, 4.0, "Steve")]
    words2 = [(3.0, 4.0, "Steve"), (5.0, 6.0, "Hello,"), (6.0, 7.0, "Steve."), (9.0, 9.5, "zzz")]
    df = spark.createDataFrame(
        [(1, "my name is Steve Hello, Steve. Bye", [(0.0, 4.0, "my name is Steve", words1), (4.0, 9.0, "Hello, Steve.", words2), (9.0, 9.5, "", None)], [(11, 16), (26, 27), (31, 34)])],
        f"doc_id int, text string, segments array<{segment}>, spans array<struct<start:int,end:int>>",
    )
    aligned = transcript.with_aligned_words(df)
    listed = [(w.word, w.char_start, w.char_end) for w in aligned.first().words]
    assert listed == [("my", 0, 2), ("name", 3, 7), ("is", 8, 10), ("Steve", 11, 16), ("Hello,", 17, 23), ("Steve.", 24, 30)]
    found = transcript.intervals(aligned)
    assert sorted((r.span, r.start, r.end) for r in found.collect()) == [(0, 3.0, 4.0), (1, 6.0, 7.0)]
    padded = transcript.padded(found.withColumn("d", F.lit(7.5)), "d", 5.0, 1.5)
    assert sorted((r.start, r.end) for r in padded.collect()) == [(0.0, 5.5), (1.0, 7.5)]
    assert [(r.start, r.end) for r in transcript.merged(padded).collect()] == [(0.0, 7.5)]
    policy = Policy(allow={"NAME_GIVEN": ["Steve"]})
    done = transcript.redact_transcripts(df, policy)
    texts = {r.segment: r.redacted_text for r in done.collect()}
    assert "Steve" not in texts[0] + texts[1] and texts[2] == ""
    (full,) = transcript.redacted_text(done).collect()
    assert full.redacted_text == "\n".join(texts[i] for i in range(3))


def test_gazetteer_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "New York and york, New  York City"), (2, None), (3, "nothing")], "doc_id int, text string"
    )
    gaz = spark.createDataFrame([("LOCATION_CITY", "New York"), ("ORGANIZATION", "york")], "label string, term string")

    def result():
        out = redact_frame(with_gazetteer(docs, gaz), Policy(), extra="extra").collect()
        return {r.doc_id: [(s.text, s.label) for s in r.spans or []] for r in out}

    want = {1: [("New York", "LOCATION_CITY"), ("york", "ORGANIZATION"), ("New  York", "LOCATION_CITY")], 2: [], 3: []}
    assert result() == want
    import veilframe.operators.gazetteer as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert result() == want


def test_restore_and_spans_random(spark):
    rng = random.Random(4)
    bits = ["a@b.co", "7", "+1 (405) 555-0142", "🌮", "é ", " ", "\n", "John", "1.2.3.4", "4444333322221111", "$5", ", ID 83702"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    df = spark.createDataFrame(docs, "id int, text string")
    for policy in (Policy(), Policy(default="Synthesis")):
        for row in redact_frame(df, policy, "text", "id", PEOPLE).collect():
            check_spans(row.text, row.spans)
            assert reconstructed(row.redacted_text, row.spans) == row.text
    assert col("a")["b"].text == "`a`.`b`"
