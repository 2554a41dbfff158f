"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: start tags with their place (the open elements' names, classes and ids, digits left out),
and blocks of text with theirs. Over the pages of a host, a token's occurrence vector is how often it stands in each page.
Tokens with equal vectors form an equivalence class. Vectors are never gathered: each is kept as the sum of one 60-bit hash
per (page, count), in two halves, with the number of pages. Sums add up in any order, so a host with a third of all pages is
counted in partial sums like any other. Empty pages are no pages of their host.

*Valid classes* have two tokens or more, a tag among them, and stand in ``least_share`` of the host's pages and in
``min_pages`` different ones. So an optional notice is a class with its elements, a menu's items are one, and the paragraphs
of an article that a host repeats are none, as no tag stands in just those pages.

*Template*: as a tag's place names the tags around it, valid classes nest by their tags: a class stands in the innermost
template tag around it. What the template's tags hold besides its own texts are its slots.

*Content*: from the whole page the search goes down to the template tag, once a page, that holds most of the slots' text, as
long as what lies beside it holds boilerplate slots (elements or classes that say so, or mostly links); an article or main
element ends it. All slots inside this region are the content.

Extraction takes the blocks in the region of the page's host that are neither texts of the template nor in a menu, header,
footer, sidebar, notice, advert, form or comment section. Pages of hosts without a template, and those without the region,
are read by their elements alone: the article's blocks if it marks one, else all that are no boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table, with_field

MIN_PAGES, LEAST_SHARE = 5, 0.5
MOST_OWN = 0.5  # a template whose texts are more than this of the pages' text is taken for copies: its texts stay
DOMINANT = 0.6
BROADCAST_TOKENS = 1_000_000  # 8 MB
SALTS = 32
INLINE_DEPTH = 64  # an inline element that ends behind more open elements stays open
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_LAX_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in "script style title textarea noscript template iframe xmp noembed noframes".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOILERPLATE = frozenset("nav footer aside form head dialog menu button select option svg object audio video canvas fieldset".split())
CONTAINERS = frozenset("html body div section article main table tbody tr td center".split())
# A class or id says boilerplate if it is one of these words, or a compound of them with words of place and shape.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices "
    "popup modal overlay sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus respond replies social "
    "share sharing related recommended newsletter subscribe signup login search widget widgets pagination pager skip".split()
)
SHAPES = frozenset(
    "bar box block wrap wrapper container section area panel list item items group row column col inner outer top bottom left right main site page global header head body "
    "button buttons btn link links icon icons form field text title content post posts article articles story stories primary secondary mobile desktop sticky fixed small large "
    "wide slot unit zone holder thread to the and in up my js wp".split()
)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN = frozenset(("article", "main"))
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def says_boilerplate(marks: str) -> bool:
    """Whether a class or id among the marks names a menu, advert or the like, as a whole."""
    for mark in marks.split():
        parts = [p.lower() for p in _PARTS.findall(mark)]
        if any(p in WORDS for p in parts) and all(p in WORDS or p in SHAPES for p in parts):
            return True
    return False


class Block:
    """A stretch of text without block-level tags in it."""

    __slots__ = ("text", "token", "parent", "boilerplate", "article", "inside")

    def __init__(self, text: str, token: int, parent: int, boilerplate: bool, article: bool, inside: bool):
        self.text, self.token, self.parent, self.boilerplate, self.article, self.inside = text, token, parent, boilerplate, article, inside


class Tag:
    """A start tag: its token, that of the tag around it, characters of text in it (``bad``: of boilerplate)."""

    __slots__ = ("token", "parent", "good", "bad", "main", "container")

    def __init__(self, token: int, parent: int, main: bool, container: bool):
        self.token, self.parent, self.main, self.container, self.good, self.bad = token, parent, main, container, 0, 0


class Open:
    """An open element; ``tag``: the innermost block-level tag."""

    __slots__ = ("name", "boilerplate", "article", "inside", "link", "tag")

    def __init__(self, name: str, boilerplate: bool, article: bool, inside: bool, link: bool, tag: Tag):
        self.name, self.boilerplate, self.article, self.inside, self.link, self.tag = name, boilerplate, article, inside, link, tag


def _hash(*parts: str) -> int:
    h = xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


_marks_memo: dict[str, tuple[str, bool]] = {}


def _marks(raw: str) -> tuple[str, bool]:
    """(classes and id without digits, whether they or other attributes say boilerplate) of a tag's attributes."""
    if raw not in _marks_memo:
        if len(_marks_memo) > 20_000:
            _marks_memo.clear()
        attributes: dict[str, str] = {}
        for k, v in _ATTRIBUTE.findall(raw):
            attributes.setdefault(k.lower(), v[1:-1] if v[:1] in ("'", '"') and v[-1:] == v[:1] and len(v) > 1 else v)
        marks = html.unescape(f"{attributes.get('class', '')} {attributes.get('id', '')}".strip())
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "") or attributes.get("role", "").lower() in ROLES
        known = " ".join(re.sub(r"\d+", "", marks).split()), hidden, says_boilerplate(marks)
        if len(raw) > 1000:
            return known
        _marks_memo[raw] = known
    return _marks_memo[raw]


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """The texts ("", "", text) and tags (name, "/" if it closes, attributes) of a page, in time that grows with its length.

    Comments, declarations and the insides of scripts, titles and the like are left out. A quote that never closes, or the
    end of the page inside a tag, makes quotes count for nothing from there on; a tag without an end is dropped.
    """
    tag_at, size, at, search = _TAG, len(page), 0, 0
    while (start := page.find("<", search)) >= 0:
        m, after = None, page[start + 1 : start + 2]
        if after in LETTERS or (after == "/" and page[start + 2 : start + 3] in LETTERS):
            m = tag_at.match(page, start)
            if m is None:
                tag_at = _LAX_TAG
                m = tag_at.match(page, start)
            end = m.end() if m else size
        elif after in ("!", "?", "/"):
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + 2)
            end = end + len(mark) if end >= 0 else size
        elif after:
            search = start + 1
            continue
        else:
            end = size
        if start > at:
            yield "", "", page[at:start]
        at = search = end
        if m:
            name = m[2].lower()
            yield name, m[1], m[3]
            if not m[1] and name in _RAW_END:
                stop = _RAW_END[name].search(page, end)
                at = search = stop.end() if stop else size
    if at < size:
        yield "", "", page[at:]


def read_page(page: str, region: int | None = None) -> tuple[list[Tag], list[Block]]:
    """The tags and blocks of a page; blocks in the ``region``'s tag, or without a region all, are ``inside``."""
    tags: list[Tag] = []
    blocks: list[Block] = []
    root = Tag(0, 0, False, True)
    stack = [Open("", False, False, region is None, False, root)]
    names: Counter = Counter()  # of the open elements
    pieces: list[str] = []
    linked = length = 0

    def end_block() -> None:
        nonlocal linked, length
        if not pieces:
            return
        text, top = " ".join(html.unescape("".join(pieces)).split()), stack[-1]
        if text:
            blocks.append(Block(text, _hash("text", str(top.tag.token), text), top.tag.token, top.boilerplate, top.article, top.inside))
            if top.boilerplate or 2 * linked >= length:
                top.tag.bad += len(text)
            else:
                top.tag.good += len(text)
        pieces.clear()
        linked = length = 0

    def pop_to(k: int) -> None:
        end_block()
        while len(stack) > k:
            one = stack.pop()
            names[one.name] -= 1
            if one.name not in INLINE:
                stack[-1].tag.good += one.tag.good
                stack[-1].tag.bad += one.tag.bad

    for name, closing, raw in events(page):
        top = stack[-1]
        if not name:
            pieces.append(raw)
            length += len(raw)
            if top.link:
                linked += len(raw)
            continue
        inline = name in INLINE
        if closing:
            if not inline:
                end_block()
            if names[name]:
                for k in range(len(stack) - 1, max(0, len(stack) - INLINE_DEPTH) if inline else 0, -1):
                    if stack[k].name == name:
                        if not inline:
                            pop_to(k)
                        else:
                            if top.boilerplate != stack[k - 1].boilerplate:
                                end_block()
                            for one in stack[k + 1 :]:  # ends in what it left open
                                one.boilerplate, one.link = stack[k - 1].boilerplate, stack[k - 1].link
                            del stack[k]
                            names[name] -= 1
                        break
            continue
        if name in _RAW_END:
            if name not in ("script", "style"):
                end_block()
            continue
        if not inline:
            end_block()
        if name in VOID:
            continue
        if name in ENDS_P or name in CLOSED_BY:
            shut = CLOSED_BY.get(name, {"p"})
            for k in range(len(stack) - 1, max(0, len(stack) - INLINE_DEPTH), -1):
                if stack[k].name in shut:
                    pop_to(k)
                    break
                if stack[k].name not in INLINE:
                    break
            top = stack[-1]
        marks, hidden, said = _marks(raw) if raw and not raw.isspace() else ("", False, False)
        main = name in MAIN
        bad = hidden or name in BOILERPLATE or (name == "header" and not top.article) or (said and not main and name not in ("html", "body"))
        if bad and not top.boilerplate:
            end_block()
        empty = raw.endswith("/")
        if inline:
            if bad or not empty:
                stack.append(Open(name, top.boilerplate or bad, top.article, top.inside, top.link or name == "a", top.tag))
                names[name] += 1
            continue
        tag = Tag(_hash(str(top.tag.token), name, marks), top.tag.token, main, name in CONTAINERS)
        tags.append(tag)
        if not empty:
            stack.append(Open(name, top.boilerplate or bad, top.article or main, top.inside or tag.token == region, top.link, tag))
            names[name] += 1
    pop_to(1)
    return tags, blocks


def host_of(url: str | None) -> str:
    """The host in lower case without port and user; without one, the empty host."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def main_text(page: str, template: tuple[int | None, frozenset[int]] | None = None) -> str:
    """The blocks of the content, by one line end. ``template``: the region's tag (None: the whole page) and its own texts."""
    region, texts = template or (None, frozenset())
    blocks = [b for b in read_page(page, region)[1] if not b.boilerplate and b.token not in texts]
    found = [b for b in blocks if b.inside] if template else []
    return "\n".join(b.text for b in found or [b for b in blocks if b.article] or blocks)


COUNTS = "host string, kind int, token long, parent long, high long, low long, pages long, times long, good long, bad long, seen long, main boolean, container boolean"
HALF = (1 << 30) - 1
PAGE, TAG, TEXT = range(3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, host and token: the vector's hash in halves, pages, places, characters of text in tags (as the page's blocks
    are, good or bad) or of texts, and 63 bits of which each page sets one. A host's pages are a token too."""
    counts: dict[tuple[str, int, int], list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in counts.items()]
        counts.clear()
        columns = list(zip(*rows, strict=True)) or [()] * 13
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 9, pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in COUNTS.split(", ")])

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not page or page.isspace():
                continue
            host = host_of(url)
            tags, blocks = read_page(page)
            own: dict[tuple[int, int], list] = {}  # times, parent, good, bad, main, container
            for t in tags:
                s = own.setdefault((TAG, t.token), [0, t.parent, 0, 0, t.main, t.container])
                s[0] += 1
                s[2] += t.good
                s[3] += t.bad
            for b in blocks:
                s = own.setdefault((TEXT, b.token), [0, b.parent, 0, 0, False, False])
                s[0] += 1
                s[2] += len(b.text)
            own[PAGE, 0] = [1, 0, sum(len(b.text) for b in blocks), 0, False, True]
            digest = _hash(page)
            hashed: dict[int, int] = {}
            for (kind, token), (times, parent, good, bad, main, container) in own.items():
                if times not in hashed:
                    hashed[times] = _hash(str(digest), str(times))
                v = counts.get((host, kind, token))
                if v is None:
                    counts[host, kind, token] = v = [parent, 0, 0, 0, 0, 0, 0, 0, main, container]
                v[1] += hashed[times] >> 30 & HALF
                v[2] += hashed[times] & HALF
                v[3] += 1
                v[4] += times
                v[5] += good
                v[6] += bad
                v[7] |= 1 << digest % 63
            if len(counts) > 200_000:
                yield flush()
    yield flush()


TEMPLATE = "host string, region long, texts array<long>"


def deduce(group: pd.DataFrame) -> pd.DataFrame:
    """The template of one host, from its page token and the tokens of its valid classes."""
    host, whole = group["host"].iloc[0], group[group["kind"] == PAGE].iloc[0]
    tags = {r.token: r for r in group[group["kind"] == TAG].itertuples()}
    texts = group[group["kind"] == TEXT]
    if texts["good"].sum() > MOST_OWN * whole["good"]:
        texts = texts.iloc[:0]
    own: Counter = Counter()  # of each tag: characters of the template's texts in it
    for r in texts.itertuples():
        at, seen = r.parent, 0
        while at in tags and seen < len(tags):
            own[at] += r.good
            at, seen = tags[at].parent, seen + 1
    once = {t for t, r in tags.items() if r.times == r.pages}
    below: dict[int, list[int]] = {}
    for t in once:
        at, seen = tags[t].parent, 0
        while at and at not in once and at in tags and seen < len(tags):
            at, seen = tags[at].parent, seen + 1
        below.setdefault(at, []).append(t)
    left = lambda t: max(0, tags[t].good - own[t])
    region, good, bad = None, sum(map(left, below.get(0, ()))), 1
    while bad and (region is None or not tags[region].main):
        best = max(((left(t), t) for t in below.get(region or 0, ()) if tags[t].container), default=(0, 0))
        if not best[0] or best[0] < DOMINANT * good:
            break
        region, good = best[1], best[0]
        bad = tags[region].bad or own[region]
    return pd.DataFrame([(host, region, texts["token"].tolist())], columns=["host", "region", "texts"]).astype({"region": "Int64"})


def templates(pages: DataFrame, url_col: str, html_col: str, min_pages: int = MIN_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, region, texts) of each host with a template: one that has ``min_pages`` different pages and a valid class."""
    pages = pages.select(F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    sums = (F.sum(c).alias(c) for c in ("high", "low", "pages", "times", "good", "bad"))
    tokens = pages.mapInArrow(_count, COUNTS).groupBy("host", "kind", "token").agg(F.min("parent").alias("parent"), *sums, F.bit_count(F.bit_or("seen")).alias("different"), F.bool_or("main").alias("main"), F.bool_or("container").alias("container"))
    # nearly all texts end here: a token of few pages cannot be in a template
    tokens = materialize(pages.sparkSession, tokens.filter((F.col("pages") >= min_pages) & (F.col("different") >= min_pages)), "page-tokens")
    hosts = tokens.filter(F.col("kind") == PAGE).select("host", F.col("pages").alias("all"))
    common = tokens.join(hosts, "host").filter(F.col("pages") >= least_share * F.col("all")).drop("all")
    vector = ["host", "high", "low", "pages"]
    classes = common.filter(F.col("kind") != PAGE).groupBy(*vector).agg(F.count("*").alias("size"), F.count_if(F.col("kind") == TAG).alias("tags"))
    valid = classes.filter("size > 1 and tags > 0").select(*vector)
    known = common.filter(F.col("kind") != PAGE).join(valid, vector, "left_semi").unionByName(common.filter(F.col("kind") == PAGE))
    # a host's group is as large as half of its pages allow: the tokens that they share
    found = known.groupBy("host").agg(F.count("*").alias("n")).filter("n > 1").select("host")
    return known.join(found, "host", "left_semi").groupBy("host").applyInPandas(deduce, TEMPLATE)


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", out_col: str = "text", min_pages: int = MIN_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``pages`` and its main text. A null, empty or blank page has the empty text, and counts for no template.

    Pages without a host share the empty one. Equal pages are one when different pages are counted (at most 63 are told
    apart), and repeated rows each get their text. An empty table stays empty. Pages of any length are read whole. A column
    named ``out_col`` is replaced, all others stay, whatever their names.
    """
    pages = pages.drop(out_col)
    names = pages.columns
    host_col, salt_col, region_col, texts_col = (fresh(c, pages) for c in ("host", "salt", "region", "texts"))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    known = materialize(pages.sparkSession, templates(pages, url_col, html_col, min_pages, least_share), "templates").withColumnsRenamed({"host": host_col, "region": region_col, "texts": texts_col})
    tokens = known.agg(F.sum(F.size(texts_col) + 2)).first()[0] or 0
    if tokens <= BROADCAST_TOKENS:  # the pages stay where they are
        both = pages.withColumn(host_col, host).join(F.broadcast(known), host_col, "left")
    else:  # a host's pages are dealt to several tasks, each with a copy of its template
        salted = known.withColumn(salt_col, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = pages.withColumns({host_col: host, salt_col: F.pmod(F.xxhash64(f"`{html_col}`", f"`{url_col}`"), F.lit(SALTS)).cast("int")})
        both = own.join(salted, [host_col, salt_col], "left")
    both = both.select(*(F.col(f"`{c}`") for c in names), region_col, texts_col)
    at, n = names.index(html_col), len(names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, frozenset] = {}
        for batch in batches:
            out = []
            for page, region, texts in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                template = None
                if texts is not None:
                    key = tuple(texts)
                    if key not in memo:
                        if len(memo) > 1000:
                            memo.clear()
                        memo[key] = frozenset(key)
                    template = region, memo[key]
                out.append(main_text(page or "", template))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.string())], names=[*names, out_col])

    return both.mapInArrow(rows, with_field(pages, out_col, "string"))


def op5_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the template of its host."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
