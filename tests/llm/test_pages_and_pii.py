"""Page differencing and personal data against brute force; the pipeline's stages."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.data import ROWS, clashing, docs, prose, text_of
from tests.llm.test_corpus import brute_classes
from veilframe.functions.sql import col
from veilframe.llm import html_extract, pii_votes


# --- pages ------------------------------------------------------------------------------


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_is_a_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(800):
        k = draw.choice([2, 3, 8])
        a = [draw.randrange(k) for _ in range(draw.randrange(30))]
        b = [draw.randrange(k) for _ in range(draw.randrange(30))]
        flags = html_extract.shared(a, b)
        some = [x for x, f in zip(a, flags, strict=True) if f]
        rest = iter(b)
        assert len(some) == longest(a, b) and all(x in rest for x in some)


def test_shared_in_bounded_memory():
    draw = random.Random(1)
    a = [draw.randrange(300) for _ in range(6000)]
    b = [draw.randrange(300) for _ in range(6000)]
    assert sum(html_extract.shared(a, b)) > 300


PAGE = (
    '<body><div class="cookie-notice">We use</div><header>Site</header><main><header><h1>T &amp; x</h1>'
    "</header><p>a<b>b</b>c<br>d<p>e &lt; f &copy<!-- no --><script>var x='<p>no</p>'</script>"
    '<aside>no</aside><form><input>no</form></main><footer>no</footer><div id="comments">'
    '<article class="comment">no</article></div><p title="x > y">out</p> < 5 <p'
)


def test_lines_of_markup():
    lines = html_extract.lines_of(PAGE)
    assert [x.text for x in lines if x.place == html_extract.IN_ARTICLE] == ["T & x", "abc", "d", "e < f ©"]
    assert [x.text for x in lines if x.place == html_extract.NO_ARTICLE] == ["out", "< 5"]


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content has-sidebar"><p>menu</p><article><p>own</p><div class="share">x</div></article></div>',
        '<main><article class="with-comments">own<div id="comments"><article>x</article></div></article></main>',
        '<body><article class="post with-comments"><p>own</p></article><div id="comments">x</div>',
        '<div class="has-sidebar"><main id="content-sidebar"><h1>own</h1></main></div><nav><article>x</article></nav>',
    ],
)
def test_names_do_not_hide_the_only_article(page):
    lines = html_extract.lines_of(page)
    assert [x.text for x in lines if x.place == html_extract.IN_ARTICLE] == ["own"]


@pytest.mark.parametrize("broken", ["<", "<p", '<a href="', "<!--", "<script>", "&", "&am", "<>", "</", "<p \"'>", "\0"])
def test_broken_markup(broken):
    assert [x[0] for x in html_extract.lines_of(f"<p>one</p>{broken}")][0] == "one"
    html_extract.lines_of(broken * 3000)


SCHEMA_PAGES = "page_id long, url string, html string, text string, flags string, item string"


def pages():
    menu = "<div>Home</div><div>News</div><div>Imprint</div>"
    rows = []
    for i in range(12):
        body = f"<div>story {i} begins</div><div>and story {i} ends</div>"
        rows.append((i, f"https://a.example/n/{i:03}.html?x={i}", f"<html><body>{menu}{body}<div>bye</div>"))
    rows += [
        (20, "http://b.example/x", "<article><p>quoted</p></article><div>menu</div>"),
        (21, "http://b.example/y", "<article><p>quoted</p><p>own</p></article><div>menu</div>"),
        (22, "http://c.example/", "<div>alone</div>"),
        (23, None, "<p>no address</p>"),
        (24, "http://d.example/1", None),
        (25, "http://d.example/2", ""),
        (26, "http://e.example/1", "<div>same</div>"),
        (27, "http://e.example/1", "<div>same</div>"),
        (28, "http://f.example/1", "<div>twin</div>"),
        (29, "http://f.example/2", "<div>twin</div><div>more</div>"),
        (30, "http://g.example/1", "<p>" + prose(3, 20_000) + "</p>"),
        (None, "http://g.example/1", "<p>short</p>"),
    ]
    return [(*r, "t", "f", "i") for r in rows]


def test_extract(spark):
    df = spark.createDataFrame(pages(), SCHEMA_PAGES)
    found = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert len(found) == len(pages())
    for i in range(12):
        assert found[i]["text"] == f"story {i} begins and story {i} ends"
    want = {
        20: "quoted", 21: "quoted own", 22: "alone", 23: "no address", 24: "", 25: "",
        26: "same", 27: "same", 28: "twin", 29: "more", None: "short",
    }
    assert {k: found[k]["text"] for k in want} == want
    assert found[30]["n_chars"] == len(prose(3, 20_000))
    assert html_extract.extract(df.limit(0)).count() == 0
    verdicts = [r for r in html_extract.compared(df).collect() if r["n_lines"] == 6]
    assert len(verdicts) == 12 and all(r["n_shared"] == 4 and r["changed"] for r in verdicts)


def texts_of(spark, htmls, host="h.example"):
    rows = [(i, f"http://{host}/{i:03}", html) for i, html in enumerate(htmls)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return [r["text"] for r in sorted(found.collect(), key=lambda r: r["page_id"])]


def test_a_telling_word_within_a_name_needs_the_comparison(spark):
    ask = '<p class="search-result">ask us</p>'
    pages = [
        f'<article><p class="search-result">the text {i}</p>{ask}<div class="comments-intro">intro {i}</div></article>'
        for i in range(3)
    ]
    assert texts_of(spark, pages) == [f"the text {i} intro {i}" for i in range(3)]
    # alone on its host nothing is shared, so nothing goes for its name
    assert texts_of(spark, pages[:1]) == ["the text 0 ask us intro 0"]


def test_links_of_an_article_go_if_shared(spark):
    links = '<p><a href="/a">Share this</a> <a href="/b">Print</a></p>'
    pages = [f'<article><p>story {i}</p><p><a href="/{i}">see {i}</a></p><p>quoted</p>{links}</article>' for i in range(2)]
    assert texts_of(spark, pages) == [f"story {i} see {i} quoted" for i in range(2)]


def test_one_of_several_articles(spark):
    replies = '<section id="responses"><article>a reader says</article></section>'
    teaser = '<article class="teaser">other story</article>'
    story = "<article><h1>Title</h1><p>The story itself is long.</p></article>"
    assert texts_of(spark, [story + replies]) == ["Title The story itself is long."]
    assert texts_of(spark, [teaser + story]) == ["Title The story itself is long."]
    # text that the partner has as well counts half
    box = "<article>a box that all pages have, with many words in it</article>"
    pages = [f"{box}<article>the story number {i} in short form</article>" for i in range(2)]
    assert texts_of(spark, pages) == [f"the story number {i} in short form" for i in range(2)]


def test_white_space_of_a_block(spark):
    assert texts_of(spark, ["<p> a\xa0&nbsp;\u2003b\x1cc\td </p>"]) == ["a b c d"]


def test_very_long_page_with_a_partner(spark):
    long = [f"<p>{w}</p>" for w in prose(6, 4_000).split()]
    one = "".join(long) + "<p>only here</p>"
    two = "".join(long[:2_000]) + "<p>and here</p>" + "".join(long[2_000:])
    assert texts_of(spark, [one, two]) == ["only here", "and here"]


def test_text_moves_only_where_the_comparison_changes_it(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = html_extract.compared(pages).collect()
    assert sum(r["copies"] for r in found) == pages.count()
    assert sum(r["n_shared"] for r in found) > 0


def test_pairs_do_not_depend_on_partitions(spark):
    draw = random.Random(4)
    rows = [(f"{i}", f"h{draw.randrange(3)}", f"/{draw.randrange(5)}/{draw.randrange(40)}") for i in range(150)]
    df = spark.createDataFrame(rows, "item string, host string, path string")
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(tuple(r) for r in html_extract.pairs(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
    of = {r[0]: r for r in rows}
    for item, partner in results[0]:
        assert of[item][1] == of[partner][1]


# --- personal data ----------------------------------------------------------------------

#: The contract's patterns as they are given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def by_hand(text):
    out = []
    for kind, pattern in GIVEN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def with_luhn(draw, n):
    front = "".join(draw.choices("0123456789", k=n - 1))
    return next(front + c for c in "0123456789" if luhn(front + c))


def test_base_spans(spark):
    draw = random.Random(5)
    parts = "a b@ @ c.d . - +1 + 5 ( 12 255 256 0 1.2.3.4 é x_ a@b.c @d.e 🙏".split() + [" ", "  ", "\n"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(25))) for _ in range(2500)]
    texts += [with_luhn(draw, n) for n in range(10, 22)] + [text_of(r) for r in ROWS]
    texts += ["1.2.3.0000255", "1.2.3.300", "a@b.c_x@d.e", "a" * 40_000 + "@" + "b.c" * 20_000]
    texts += ["9" * 40_000, "1.2" * 20_000, "+1" + "-" * 40_000, "a." * 30_000]
    df = docs(spark, list(enumerate(texts)))
    found = pii_votes.found(df, "text", "f").select(
        "doc_id", pii_votes.joined(col("f")["base"]).column().alias("s")
    )
    for r in found.collect():
        assert r["s"] == by_hand(texts[r["doc_id"]]), texts[r["doc_id"]][:80]


def secrets(spark, n=300):
    draw = random.Random(8)
    rows = []
    for i in range(n):
        hexed = "".join(draw.choices("0123456789abcdef", k=24))
        card = "".join(draw.choices("0123456789", k=16))
        what = ["in version 2.0 of", f"a password={hexed} for", f"card {card} of", "part 3 of", "nothing"][i % 5]
        rows.append((i, f"{prose(i, 10).translate(dict.fromkeys(range(48, 58)))} {what} the rest"))
    return rows


def test_votes_find_more(spark):
    rows = secrets(spark)
    spans = pii_votes.found(docs(spark, rows), "text", "f").cache()
    model = pii_votes.fit(spans, "f")
    found = spans.select("doc_id", "text", pii_votes.all_spans(col("f"), model).column().alias("s"))
    for r in found.collect():
        some = [r["text"][s["start"] : s["end"]] for s in r["s"]]
        if r["doc_id"] % 5 == 1:
            assert some and some[0].startswith("password="), r
        elif r["doc_id"] % 5 == 2:
            assert len(some) == 1 and len(some[0]) == 16, r
        else:
            assert not some, r


def test_candidates_in_dense_texts(spark):
    key = "AKIA" + "Q7ZK" * 4
    cases = {
        '{"mail":"a@b.cc","token":"24be01"}': ["24be01"],
        f"http://h/p?user=x@y.zz&key={key}&n=10.0.0.1;id=77": [f"key={key}", "id=77"],
        "password hunter, then rest": ["hunter"],
        '{"password": "hunter"} a1': ["hunter", "a1"],
        "🙏 a@b.cc x1 1.2.3.4": ["x1"],
        "1.2.3.4-x9 plain words only": ["-x9"],
        "abc== end == x": ["abc=="],
        "token = hunter": ["hunter"],
        'key="zz11yy" a@b.cc': ["zz11yy"],
    }
    df = docs(spark, list(enumerate(cases)))
    for r in pii_votes.found(df, "text", "f").collect():
        got = r["f"]["candidates"]
        assert [r["text"][c["start"] : c["end"]] for c in got] == cases[r["text"]], r
        if '"token"' in r["text"] or "password" in r["text"]:
            assert got[0]["votes"][5] == 1, r


def test_em_recovers_reliabilities():
    draw = np.random.default_rng(3)
    truth = draw.random(20_000) < 0.3
    accuracy = [0.9, 0.8, 0.7, 0.6]
    votes = np.stack(
        [np.where(draw.random(20_000) < a, truth, ~truth) * 2 - 1 for a in accuracy], axis=1
    )
    votes[draw.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, prior, table = pii_votes.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - 0.3) < 0.05
    for j, a in enumerate(accuracy):
        right = table[1, j, 2] / (table[1, j, 2] + table[1, j, 0])
        assert abs(right - a) < 0.06


def test_redaction(spark):
    rows = [
        (1, "mail a.b@c.de and 1.2.3.4, call +49 (30) 1234567 now"),
        (2, None), (3, ""), (4, "clean text"),
        (5, " ".join(f"x{i}@y.zz" for i in range(500))),
    ]
    df = docs(spark, rows).selectExpr("*", "'s' AS spans", "1 AS _found")
    done = pii_votes.redact(df, pii_votes.NO_MODEL)
    assert done.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    assert got[1] == "mail [EMAIL] and [IP], call [PHONE] now"
    assert got[2] is None and got[3] == "" and got[4] == "clean text"
    assert got[5] == " ".join(["[EMAIL]"] * 500)
    assert pii_votes.redact(docs(spark, []), pii_votes.NO_MODEL).count() == 0


def test_annotation_takes_all_rows(spark):
    found = pii_votes.annotate(clashing(spark), pii_votes.NO_MODEL)
    assert found.count() == len(ROWS) and found.columns.count("spans") == 1
    none = pii_votes.found(docs(spark, []), "text", "f")
    assert pii_votes.fit(none, "f") == pii_votes.NO_MODEL
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- the pipeline -----------------------------------------------------------------------


def test_stages_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing",
    ]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, df, sf_dir)
    assert kept.columns == df.columns
    kept = spark.createDataFrame(kept.collect(), df.schema)
    once = stage["exact dedup"](spark, kept, sf_dir)
    best = {}
    for r in kept.collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(best.values())
    rows = sorted(once.collect(), key=lambda r: r["doc_id"])
    label, _ = brute_classes([r["text"] or "" for r in rows])
    apart = stage["n-gram Jaccard join"](spark, spark.createDataFrame(rows, df.schema), sf_dir)
    assert apart.columns == df.columns
    left = sorted(r["doc_id"] for r in apart.collect())
    assert left == sorted({rows[i]["doc_id"] for i in label})
    clean = stage["PII"](spark, spark.createDataFrame(apart.collect(), df.schema), sf_dir)
    assert clean.columns == df.columns
    for r in clean.collect():
        assert by_hand(r["text"] or "") == ""
    packed = stage["best-fit packing"](spark, spark.createDataFrame(clean.collect(), df.schema), sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(left)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_take_all_rows(spark, sf_dir, rows):
    now = docs(spark, rows).selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        now = spark.createDataFrame(now.collect(), now.schema)
    assert (now.count() > 0) == bool(rows)
