"""Main text of web pages: nearest-URL page differencing.

A page becomes lines, one per block element, with what its markup says about them.  Within
a host the pages are sorted by URL path, and each is paired with the neighbour whose path
has the longest common beginning with its own; pages of equal lines count as one page,
so a page is never compared with a copy of itself.  The lines of a pair are aligned by
their longest common subsequence, and lines that a page shares with its partner belong to
the template.

What the markup says for certain stands above the comparison: elements that are never
article text (menus, footers, forms, elements named ``comments``, ...) go, since menus and
adverts often differ from page to page; and plain lines of an ``article`` stay although
shared, since articles quote and repeat each other.  The comparison decides the rest:

* without an ``article`` or ``main`` shared lines go (if all are shared, they stay);
* an element whose class or id only holds a telling word (``search-result``) loses its lines
  if they are shared, or are mostly links;
* lines of an article that are mostly links go if they are shared;
* of several articles the one with the most text is taken, where shared text counts half.

A class or id name alone does not exclude an ``article`` or ``main``, or one inside the
element so named, if the page would be left without any.

Texts move as little as they can: keys, sizes and marks of lines are compared, one row per
page; a page's text is cut where the page lies, and only pages whose text the comparison
changes (found by a bit filter that is broadcast) meet their marks in a join.

White space is what Python's ``str.split`` takes for it: Unicode white space, no-break
spaces among it, and the four ASCII separators.

Results for special rows: null or empty html gives the empty text; a null URL is a host of
its own, without path; equal pages give equal texts; a page alone on its host is judged by
its markup; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import html as entities
import os.path
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bound_batches, plain, settled
from .membership import may_be_among

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.DOTALL,
)
#: A tag whose quotes do not match, or that the end of the page cuts off.
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")

BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div "
    "dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr "
    "html legend li main menu nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
#: Their content is no markup.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed".split())
NEVER = RAW | frozenset(
    "head nav footer aside form button select option menu dialog object canvas svg audio video "
    "map datalist".split()
)
ARTICLE = frozenset(["article", "main"])
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu "
    "menubar toolbar".split()
)
#: Words of class and id that name something else than the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promoted "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription "
    "signup share sharing social sidebar widget widgets related recommended recommendations "
    "breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer comment comments "
    "disqus reply replies respond login search toolbar skip".split()
)
IN_ARTICLE, ELSEWHERE, NO_ARTICLE = 2, 1, 0
WEAK, STRONG = 1, 2


def _attributes(text: str) -> dict[str, str]:
    return {
        m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)
    }


def _is_other(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element holds something else than article text, whatever its names."""
    if tag in NEVER:
        return True
    if tag in ("html", "body"):
        return False
    if tag == "header":
        return not in_article
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def _naming(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """What class and id say: STRONG if one of their names consists of words for something
    else than the article, WEAK if one only holds such a word, else 0."""
    if tag in ("html", "body", "header") or not attributes:
        return 0
    found = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(WORDS.findall(name))
        telling = {w for w in words if w in NAMES or (w == "header" and not in_article)}
        if telling:
            found = max(found, STRONG if telling == words else WEAK)
    return found


class Line(NamedTuple):
    """A block of a page: its text; IN_ARTICLE, ELSEWHERE (not article text by its markup)
    or NO_ARTICLE (the markup does not say); the tags it hangs in; whether a name holds a
    telling word; whether it is mostly links; the number of its article, 0 for none."""

    text: str
    place: int
    tags: str
    weak: bool
    links: bool
    article: int


def lines_of(page: str) -> list[Line]:
    """The blocks of a page in order."""
    found, hidden = _lines(page, False)
    if hidden and not any(x.place == IN_ARTICLE for x in found):
        found, _ = _lines(page, True)
    return found


class _Open(NamedTuple):
    """An open element and what it hands down."""

    tag: str
    other: bool = False
    article: bool = False
    hard: bool = False  # other by more than names
    weak: bool = False
    link: bool = False
    number: int = 0


def _lines(page: str, unnamed: bool) -> tuple[list[Line], bool]:
    """The lines, and whether names alone exclude an article; with ``unnamed`` they do not."""
    found: list[Line] = []
    stack: list[_Open] = []
    outside = _Open("")
    parts: list[str] = []
    linked = numbers = 0
    hidden = False

    def end_block() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(raw.split())
            parts.clear()
            if text:
                top = stack[-1] if stack else outside
                place = ELSEWHERE if top.other else IN_ARTICLE if top.article else NO_ARTICLE
                tags = "/".join(s.tag for s in stack if s.tag in BLOCKS)
                found.append(Line(text, place, tags, top.weak, 2 * linked > len(raw), top.number))
        linked = 0

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            text = page[at:begin]
            parts.append(entities.unescape(text) if "&" in text else text)
            if stack and stack[-1].link:
                linked += len(parts[-1])
        if begin == size:
            break
        tag = TAG.match(page, begin) or BROKEN.match(page, begin)
        if tag is None:
            parts.append("<")
            at = begin + 1
            continue
        at = tag.end()
        if tag.lastindex is None:
            continue  # a comment or a declaration
        closing, name = tag[1], tag[2].lower()
        if name in BLOCKS:
            end_block()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
            continue
        attributes = _attributes(tag[3]) if tag[3].strip(" /\t\r\n") else {}
        up = stack[-1] if stack else outside
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else size
            continue
        if name in VOID:
            continue
        role = attributes.get("role", "").lower()
        mine = name in ARTICLE or role in ("main", "article")
        inside = up.article and up.other  # such as the comments of an article
        naming = _naming(name, attributes, up.article or mine)
        hard = up.hard or _is_other(name, attributes, up.article or mine)
        other = up.other or hard or naming == STRONG
        if mine and other and not hard and not inside:
            hidden, other = True, not unnamed
        number = up.number
        if name == "article" or role == "article":
            numbers += 1
            number = numbers
        # names above an article say nothing about it
        weak = (up.weak and not mine) or (naming == WEAK and not mine)
        stack.append(
            _Open(name, other, up.article or (mine and not other), hard, weak, up.link or name == "a", number)
        )
    end_block()
    return found, hidden


def chosen(lines: Sequence[tuple[int, bool, bool, int, int]], shared: Sequence[bool]) -> list[bool]:
    """Which lines (place, weak, links, article, size) are the page's text, given which it
    shares with its partner."""

    def stays(i: int) -> bool:
        _, weak, links, _, _ = lines[i]
        return not (shared[i] and (weak or links)) and not (weak and links)

    places = [x[0] for x in lines]
    inside = [i for i, place in enumerate(places) if place == IN_ARTICLE]
    if inside:
        weight: dict[int, int] = {}
        for i in inside:
            number, size = lines[i][3], lines[i][4]
            weight[number] = weight.get(number, 0) + size * (1 if shared[i] else 2)
        numbers = [n for n in weight if n] or [0]
        best = max(numbers, key=lambda n: (weight[n], -n))
        inside = [i for i in inside if lines[i][3] in (0, best)]
        taken = [i for i in inside if stays(i)] or inside
    else:
        loose = [i for i, place in enumerate(places) if place == NO_ARTICLE]
        taken = [i for i in loose if not shared[i] and stays(i)] or loose
    keep = [False] * len(lines)
    for i in taken:
        keep[i] = True
    return keep


def _key(text: str, tags: str) -> int:
    digest = hashlib.blake2b(f"{tags}\0{text}".encode("utf-8", "replace"), digest_size=8)
    return int.from_bytes(digest.digest(), "little", signed=True)


def _shape(line: Line) -> int:
    """What ``chosen`` needs of a line as one integer."""
    return (((line.article << 1 | line.links) << 1 | line.weak) << 2 | line.place) << 32 | len(line.text)


def _unshape(value: int) -> tuple[int, bool, bool, int, int]:
    marks = value >> 32
    return marks & 3, bool(marks >> 2 & 1), bool(marks >> 3 & 1), marks >> 4, value & 0xFFFFFFFF


def shapes(html: Column | str) -> Column:
    """Struct of keys and shapes of a page's lines; a key stands for a line's text and where
    it hangs in the page."""

    bound_batches()

    @F.pandas_udf("keys array<long>, shapes array<long>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [lines_of(p) for p in plain(batch)]
            yield pd.DataFrame(
                {
                    "keys": [[_key(x.text, x.tags) for x in p] for p in pages],
                    "shapes": [[_shape(x) for x in p] for p in pages],
                }
            )

    return cut(html)


def _text(page: str, keep: Sequence[bool] | None) -> str:
    lines = lines_of(page)
    if keep is None:
        keep = chosen([_unshape(_shape(x)) for x in lines], [False] * len(lines))
    return " ".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def text_by_markup(html: Column | str) -> Column:
    """A page's text where nothing is shared."""

    @F.pandas_udf("string")
    def cut(pages: pd.Series) -> pd.Series:
        return pd.Series([_text(p, None) for p in plain(pages)], dtype=object)

    return cut(html)


def text_of(html: Column | str, keep: Column | str) -> Column:
    """A page's text: the lines that ``keep`` marks, all the markup leaves where it is null."""

    @F.pandas_udf("string")
    def cut(pages: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series(
            [_text(p, k) for p, k in zip(plain(pages), keep, strict=True)], dtype=object
        )

    return cut(html, keep)


# --- longest common subsequence ---------------------------------------------------------


def shared(mine: list[int], other: list[int]) -> list[bool]:
    """Which elements of ``mine`` lie in a longest common subsequence with ``other``.

    Bit-parallel: a row of the table is one integer with a bit per element of ``other``.
    Every ``step``-th row is kept and the rows between are computed again on the way back,
    so memory grows with the square root of the length, times a bit per element.
    """
    flags = [False] * len(mine)
    low, n, m = 0, len(mine), len(other)
    while low < min(n, m) and mine[low] == other[low]:
        flags[low] = True
        low += 1
    while n > low and m > low and mine[n - 1] == other[m - 1]:
        n, m = n - 1, m - 1
        flags[n] = True
    a, b = mine[low:n], other[low:m]
    if not a or not b:
        return flags
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1

    def row(v: int, x: int) -> int:
        u = v & places.get(x, 0)
        return ((v + u) | (v - u)) & full

    step = max(1, int(len(a) ** 0.5))
    kept, v = [full], full
    for i, x in enumerate(a, 1):
        v = row(v, x)
        if i % step == 0:
            kept.append(v)
    i, j = len(a), len(b)
    block, rows = -1, []

    def table(r: int) -> int:
        """The row after ``r`` elements."""
        nonlocal block, rows
        if r // step != block:
            block = r // step
            rows = [kept[block]]
            for x in a[block * step : (block + 1) * step]:
                rows.append(row(rows[-1], x))
        return rows[r - block * step]

    while i and j:
        if table(i) >> (j - 1) & 1:
            # down to the nearest element that lengthens the row
            zeros = ~table(i) & ((1 << (j - 1)) - 1)
            j = zeros.bit_length()
            continue
        i -= 1
        if i and not table(i) >> (j - 1) & 1:
            continue
        j -= 1
        flags[low + i] = True
    return flags


def decided(keys: Column | str, other: Column | str, shapes: Column | str) -> Column:
    """Struct of a page against its partner (null: none): number of shared lines, whether
    that changes its text, and if so which lines stay."""

    @F.pandas_udf("n_shared long, changed boolean, keep array<boolean>")
    def compare(keys: pd.Series, other: pd.Series, shapes: pd.Series) -> pd.DataFrame:
        out = []
        for mine, its, shape in zip(keys, other, shapes, strict=True):
            lines = [_unshape(x) for x in shape.tolist()]
            none = [False] * len(lines)
            flags = none if its is None else shared(mine.tolist(), its.tolist())
            keep = chosen(lines, flags)
            changed = keep != chosen(lines, none)
            out.append((sum(flags), changed, keep if changed else None))
        return pd.DataFrame(out, columns=["n_shared", "changed", "keep"])

    return compare(keys, other, shapes)


# --- pairs ------------------------------------------------------------------------------

PAIR = "item string, partner string, part int, edge int, host string, path string, alike int"


def _alike(a: tuple, b: tuple) -> int:
    """Length of the common beginning of two paths, -1 on different hosts."""
    return len(os.path.commonprefix([a[2], b[2]])) if a[1] == b[1] else -1


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partners among the sorted pages of a partition; its ends are marked."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    before: tuple | None = None
    now: tuple | None = None

    def line(after: tuple | None) -> tuple:
        best, partner = -1, None
        for near in (before, after):
            if near is not None and _alike(now, near) > best:
                best, partner = _alike(now, near), near[0]
        return (
            now[0], partner, part, (before is None) + 2 * (after is None), now[1], now[2], best
        )

    columns = [c.split()[0] for c in PAIR.split(", ")]
    for batch in batches:
        out = []
        for row in zip(batch["item"], batch["host"], batch["path"], strict=True):
            if now is not None:
                out.append(line(row))
                before = now
            now = row
        yield pd.DataFrame(out, columns=columns)
    if now is not None:
        yield pd.DataFrame([line(None)], columns=columns)


def pairs(pages: DataFrame) -> DataFrame:
    """(item, partner) for ``pages`` of (item, host, path): the neighbour by path within the
    host with the longest common beginning, null without any.

    The pages are sorted over all machines, so a host may hold any share of them.  Only
    the first and the last page of a partition look beyond it; the driver pairs these.
    """
    ordered = pages.repartitionByRange("host", "path", "item").sortWithinPartitions(
        "host", "path", "item"
    )
    found = settled(ordered.mapInPandas(_neighbours, PAIR), "pairs")
    ends = sorted(  # at most two for each partition
        found.where("edge > 0").collect(), key=lambda r: (r["part"], r["host"], r["path"], r["item"])
    )
    mended = []
    for i, end in enumerate(ends):
        best, partner = end["alike"], end["partner"]
        for near in (ends[i - 1] if i else None, ends[i + 1] if i + 1 < len(ends) else None):
            if near is not None and near["part"] != end["part"]:
                alike = _alike(
                    (None, end["host"], end["path"]), (None, near["host"], near["path"])
                )
                if alike > best:
                    best, partner = alike, near["item"]
        mended.append((end["item"], partner))
    spark = pages.sparkSession
    return (
        found.where("edge = 0")
        .select("item", "partner")
        .unionByName(spark.createDataFrame(mended, "item string, partner string"))
    )


def _addressed(df: DataFrame, url: str, html: str) -> DataFrame:
    """``df`` as (url, html, host, path, page): ``page`` stands for host and html."""
    address = F.coalesce(F.col(url), F.lit(""))
    after_host = F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    host = F.lower(
        F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)
    )
    return df.withColumns(
        {
            "host": host,
            "path": F.regexp_replace(after_host, "/+$", ""),
            "html": F.coalesce(F.col(html), F.lit("")),
        }
    ).withColumn("page", F.unhex(F.substring(F.sha2(F.concat_ws("\n", "host", "html"), 256), 1, 32)))


def compared(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Every distinct page (page, copies, n_lines, n_shared, changed, keep) of ``df`` against
    its partner, as a written table: ``keep`` marks the lines that stay where the comparison
    changes the page's text."""
    pages = settled(
        _addressed(df.select(F.col(url).alias("url"), F.col(html).alias("html")), "url", "html")
        .select("page", "host", "path", shapes("html").alias("lines"))
        .withColumn("item", F.sha2(F.concat_ws("\n", "host", F.array_join("lines.keys", " ")), 256))
        .groupBy("page")
        .agg(
            F.first("item").alias("item"),
            F.min("host").alias("host"),
            F.min("path").alias("path"),
            F.first("lines").alias("lines"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "pages",
    )
    # pages of a host with the same lines are one page
    items = settled(
        pages.groupBy("item").agg(
            F.min("host").alias("host"),
            F.min("path").alias("path"),
            F.first("lines.keys").alias("keys"),
            F.first("lines.shapes").alias("shapes"),
            F.count(F.lit(1)).alias("pages"),
        ),
        "items",
    )
    partners = pairs(items.select("item", "host", "path"))
    others = items.select(F.col("item").alias("partner"), F.col("keys").alias("other"))
    verdicts = settled(
        items.join(partners, "item")
        .join(others, "partner", "left")
        .select(
            "item",
            "pages",
            F.size("keys").cast("long").alias("n_lines"),
            decided("keys", "other", "shapes").alias("verdict"),
        ),
        "verdicts",
    )
    met = attach(
        pages.select("page", "item", "copies"), verdicts, "item", "pages", ["page"],
        F.struct("n_lines", "verdict"), "of",
    )
    return settled(
        met.select("page", "copies", "of.n_lines", "of.verdict.n_shared", "of.verdict.changed", "of.verdict.keep"),
        "compared",
    )


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row of ``df``."""
    changed = compared(df, url, html).where("changed").select(
        "page", F.xxhash64("page").alias("hashed"), "copies", "keep"
    )
    rows = _addressed(
        df.select(F.col(key).alias("id"), F.col(url).alias("address"), F.col(html).alias("html")),
        "address",
        "html",
    ).select("id", "address", "html", "page", F.xxhash64("page").alias("hash"))
    tested = may_be_among(rows, "hash", changed, "hashed", "maybe")
    alone = tested.where("NOT maybe").select("id", "address", text_by_markup("html").alias("text"))
    marked = attach(
        tested.where("maybe"), changed, "page", "copies", ["id", "address"], F.col("keep"), "keep"
    )
    joined = alone.unionByName(marked.select("id", "address", text_of("html", "keep").alias("text")))
    return joined.select(
        F.col("id").alias(key),
        F.col("address").alias(url),
        "text",
        F.length("text").cast("long").alias("n_chars"),
    )
