"""Main text by nearest-URL page differencing (operator 10).

Pages of a host are put in order of their URL paths; each is paired with up to NEAR
pages before and after it. Lines (blocks) of a pair are aligned by longest common
subsequence, and lines that enough neighbours share go: two of them, or the one
where a page has no more. Elements named in the contract (menus, headers, footers,
sidebars, notices, adverts, forms, comments) go by markup, as they may differ from
page to page. Where a page has an article or main element, what lies outside it goes
too, and inside it differencing takes the lines that frame the text (before the
first or after the last line of its own); elsewhere it takes shared lines at any
place. A neighbour that shares most of a page's text is a copy, not another page of
one template; it has no vote.

Defined cases: null or empty html has an empty text; a null url counts as empty;
repeated rows are compared once and returned each; ties of path go by page id; a
page alone on its host loses nothing to differencing; an empty table gives no rows; a
page of any length is parsed in one task, and the table of a pair of long pages is
halved until it fits TABLE_BITS. Of the input's columns only id, url and html are
read, so the others may have any name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import cut

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.DOTALL)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")

# Element names and words of class, id and role.
RAW = {"script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "math"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"} | RAW
MAIN = {"article", "main"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "reply", "replies", "respond",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
ASIDE_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "navigation", "search"}
MAIN_WORDS = {"articlebody", "article", "entry", "story", "content", "post"}
#: Parts of a name that says how its element looks, not what it is; names of reader comments, which are articles in some markup.
STATE_WORDS = {"no", "with", "without", "has", "is", "enabled", "disabled", "hide", "show"}
COMMENT_WORDS = {"comment", "comments", "reply", "replies"}


def attributes(tag: str) -> dict[str, str]:
    found = _ATTR.findall(tag[_NAME.match(tag).end() : -1])
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in found}


def named(words: str) -> tuple[bool, bool]:
    """Whether names of a class or id attribute are those of a main container, and of boilerplate."""
    main = aside = False
    for name in words.lower().split():
        parts = re.split(r"[^a-z0-9]+", name)
        main |= name in MAIN_WORDS or bool(parts) and parts[-1] in MAIN_WORDS
        aside |= not STATE_WORDS & set(parts) and bool(ASIDE_WORDS & set(parts)) and parts[-1] not in MAIN_WORDS
    return main, aside


def kind_of(name: str, tag: str) -> str:
    """``b`` for boilerplate, ``m`` for a main container, ``w`` for one only by its words, else nothing. Signs of a main container go before those of boilerplate."""
    if name in ASIDE:
        return "b"
    if "=" not in tag and "hidden" not in tag:
        return "m" if name in MAIN else ""
    at = attributes(tag)
    role = at.get("role", "").lower()
    main, aside = named(f"{at.get('class', '')} {at.get('id', '')}")
    if name not in ("body", "html") and ("hidden" in at or at.get("aria-hidden") == "true"):
        return "b"
    if name in MAIN or role in ("main", "article") or at.get("itemprop", "").lower() == "articlebody":
        return "b" if aside and COMMENT_WORDS & set(re.split(r"[^a-z0-9]+", at.get("class", "").lower())) else "m"
    if name in ("div", "section") and main:
        return "w"
    return "b" if name not in ("body", "html") and (aside or role in ASIDE_ROLES) else ""


def lines_of(page: str) -> tuple[list[str], str]:
    """The page's lines, decoded and with single spaces, and a zone letter for each: m in a main container, b boilerplate by markup, o other."""
    tokens, at = [], 0
    skip_to, lower = "", None
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            tokens.append(("", page[at : m.start()], ""))
        at = m.end()
        tag = m.group()
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                tokens.append(("", entities_safe(tag[9:].removesuffix("]]>")), ""))
            continue
        name = _NAME.match(tag).group(1).lower()
        if name in RAW and tag[1] != "/":  # its content is not markup
            if not tag.endswith("/>"):
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{name}", at) if len(lower) == len(page) else page.find(f"</{name}", at)
                end = len(page) if end < 0 else end
                close = page.find(">", end)
                at = len(page) if close < 0 else close + 1
            tokens.append(("block", "", ""))
            continue
        tokens.append((name, tag, "/" if tag[1] == "/" else "v" if name in VOID or tag.endswith("/>") else ""))
    if at < len(page):
        tokens.append(("", page[at:], ""))

    # an element that is never closed marks nothing
    closes: dict[str, list[int]] = {}
    end_of: dict[int, int] = {}
    for i in range(len(tokens) - 1, -1, -1):
        name, _, how = tokens[i]
        if how == "/":
            closes.setdefault(name, []).append(i)
        elif name and not how and name != "block" and closes.get(name):
            end_of[i] = closes[name].pop()

    lines, zones, text = [], [], []
    aside_until = main_until = word_until = -1

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if line:
                lines.append(line)
                zones.append("b" if aside_until >= 0 else "m" if main_until >= 0 else "w" if word_until >= 0 else "o")

    for i, (name, raw, how) in enumerate(tokens):
        if not name:
            text.append(raw)
            continue
        if name not in INLINE:
            flush()
        if i in end_of and aside_until < 0:
            what = kind_of(name, raw)
            if what:
                flush()
            if what == "b":
                aside_until = end_of[i]
            elif what == "m" and main_until < 0:
                main_until = end_of[i]
            elif what == "w" and word_until < 0:
                word_until = end_of[i]
        if i >= aside_until >= 0:
            flush()
            aside_until = -1
        if i >= main_until >= 0:
            flush()
            main_until = -1
        if i >= word_until >= 0:
            flush()
            word_until = -1
    flush()
    joined = "".join(zones)
    return lines, joined.replace("w", "o" if "m" in joined else "m")


def entities_safe(text: str) -> str:
    return text.replace("&", "&amp;")


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Row i of the subsequence table of a[:i] and b, as bits: a zero where the length grows."""
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        v, m = rows[-1], where.get(x, 0)
        rows.append(((v + (v & m)) | (v & ~m)) & full)
    return rows


#: Bits of one table; longer pairs are halved, which costs twice the time and bounded memory.
TABLE_BITS = 200_000_000


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    mid_a, mid_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    in_a, in_b = set(mid_a), set(mid_b)
    at = [i for i, x in enumerate(mid_a) if x in in_b]
    x, y = [mid_a[i] for i in at], [v for v in mid_b if v in in_a]
    return [*range(lo), *(lo + at[i] for i in _matched(x, y)), *range(len(a) - hi, len(a))]


def _matched(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        head, tail = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(head + tail))
        return [*_matched(a[:half], b[:cut]), *(half + i for i in _matched(a[half:], b[cut:]))]
    rows, out, i, j = _rows(a, b), [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if i and not rows[i] >> (j - 1) & 1:
                continue
            j -= 1
            out.append(i)
    return out[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Subsequence lengths of all of ``a`` with every prefix of ``b``."""
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        m = where.get(x, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


#: Pages before and after that a page is compared with.
NEAR = 2
#: Share of the lines of an article element, and of the characters of a page without one, beyond which two pages are copies of each other.
COPY, COPY_CHARS = 0.3, 0.8


def deleted(own: list[int], zones: str, others: list[list[int]], sizes: list[int] | None = None) -> list[int]:
    """Positions of the lines that differencing takes from a page; sizes are the lines' characters."""
    inside = "m" if "m" in zones else "o"
    body = [i for i, z in enumerate(zones) if z == inside]
    weight = sizes or [1] * len(own)
    outside, votes = set(), []
    for other in others:
        shared = set(common(own, other))
        outside |= {i for i in shared if zones[i] != inside}
        found = {i for i in shared if zones[i] == inside}
        copied = len(found) > COPY * len(body) if inside == "m" else sum(weight[i] for i in found) > COPY_CHARS * sum(weight[i] for i in body)
        if body and not copied:
            votes.append(found)
    gone: set[int] = set()
    if inside == "o" and votes:
        need = min(2, len(votes))
        gone = {i for i in body if sum(i in v for v in votes) >= need}
    elif len(votes) >= 2:
        both = {i for i in body if sum(i in v for v in votes) >= 2}
        for order in (body, body[::-1]):
            for i in order:
                if i not in both:
                    break
                gone.add(i)
    return sorted(outside | gone)


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [lines_of(x) for x in pdf["html"]]
            yield pd.DataFrame({
                "id": pdf["id"], "rowkey": pdf["rowkey"], "url": pdf["url"], "lines": [x[0] for x in found], "zones": [x[1] for x in found],
                "sizes": [list(map(len, x[0])) for x in found],
                "marks": [[xxhash.xxh64_intdigest(line.encode()) - (1 << 63) for line in x[0]] for x in found],
            })

    page = F.coalesce(F.col(html_col), F.lit(""))
    src = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")), page).alias("rowkey"),
        F.col(url_col).alias("url"),
        page.alias("html"),
    )
    return src.mapInPandas(batches, "id string, rowkey long, url string, lines array<string>, zones string, sizes array<int>, marks array<long>")


def neighbours(sig: DataFrame) -> DataFrame:
    """Adds ``near``: the marks of up to NEAR pages before and after in (host, path) order, of the same host.

    The order is by range, so a host with most pages spreads over many tasks; the
    rows at range borders meet by a join on the range's number with its ends.
    """
    order = ("host", "path", "id", "rowkey")
    ranged = cut(sig.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy(*order)
    mate = F.struct("host", "marks")
    back, ahead = w.rowsBetween(-NEAR, -1), w.rowsBetween(1, NEAR)
    near = ranged.withColumn("before", F.collect_list(mate).over(back)).withColumn("after", F.collect_list(mate).over(ahead))
    falling = Window.partitionBy("part").orderBy(*(F.desc(c) for c in order))
    ends = ranged.withColumn("at", F.row_number().over(w)).withColumn("to", F.row_number().over(falling)).where((F.col("at") <= NEAR) | (F.col("to") <= NEAR))
    ordered = lambda flag, n: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct(n, "host", "marks")))), lambda x: F.struct(x["host"], x["marks"]))
    ends = ends.groupBy("part").agg(ordered(F.col("at") <= NEAR, "at").alias("first"), ordered(F.col("to") <= NEAR, "to").alias("last"))
    across = Window.orderBy("part")  # one row for each range
    ends = ends.select("part", F.lag("last").over(across).alias("prior"), F.lead("first").over(across).alias("next"))
    near = near.join(ends, "part", "left")
    none = F.filter(F.array(mate), lambda x: F.lit(False))
    fill = lambda own, more: F.concat(own, F.slice(F.coalesce(more, none), F.lit(1), F.lit(NEAR) - F.size(own)))
    all_ = F.concat(fill(F.col("before"), F.col("prior")), fill(F.col("after"), F.col("next")))
    same = F.filter(all_, lambda x: x["host"] == F.col("host"))
    return near.withColumn("near", F.transform(same, lambda x: x["marks"]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url, text, n_chars, n_lines and n_deleted (lines that differencing took) of every page."""
    parsed = _parsed(pages, id_col, url_col, html_col)
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][-+.\w]*://([^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z][-+.\w]*://[^/]*", ""), r"(?:/|\.html?)$", "")
    sig = parsed.select("id", "rowkey", host.alias("host"), path.alias("path"), "marks", "sizes", "zones").dropDuplicates(["rowkey"])

    @F.pandas_udf("array<int>")
    def gone(own: pd.Series, zones: pd.Series, sizes: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series([deleted(list(o), z, [list(x) for x in others], list(n)) for o, z, n, others in zip(own, zones, sizes, near)])

    cuts = neighbours(sig).select("rowkey", gone("marks", "zones", "sizes", "near").alias("gone"))
    joined = parsed.drop("marks", "sizes").join(cuts, "rowkey", "left")
    zone = F.when(F.col("zones").contains("m"), "m").otherwise("o")
    kept = F.filter(
        F.arrays_zip("lines", F.transform(F.sequence(F.lit(0), F.size("lines")), lambda i: i).alias("at")),
        lambda x: x["lines"].isNotNull() & (F.substring(F.col("zones"), x["at"] + 1, F.lit(1)) == zone) & ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), x["at"]),
    )
    text = F.array_join(F.transform(kept, lambda x: x["lines"]), " ")
    out = joined.withColumn("text", text)
    return out.select(
        F.col("id").cast(pages.schema[id_col].dataType).alias(id_col), "url", "text", F.char_length("text").cast("long").alias("n_chars"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
    )
