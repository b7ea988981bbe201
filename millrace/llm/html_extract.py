"""HTML extraction by nearest-URL page differencing.

1. A page becomes text lines (blocks), each in a zone: declared article, chrome (menus, headers, footers, sidebars,
   notices, adverts, forms, reader comments: by element, role, class and id), or open.
2. Pages are ordered by host and URL path; a page is paired with its neighbours on its host, the nearest one being that whose
   path shares the longer prefix.  Lines are aligned by a longest common subsequence; zones must agree, too.
3. Chrome goes, and shared lines go where they are template:
   * Where no article is declared, shared lines before the first and after the last open line of the page's own; shared
     ones between are prose that repeats.  A neighbour with the same lines is a copy and tells nothing.
   * Declared articles are the text unless open lines of the page's own are more than twice as long (the articles are teasers then).
   * Inside a declared article (article, main), the lines at its beginning and end that both neighbours share and that
     stand in articles of half of the host's pages, three at least ("Share this", "More on this site").  A neighbour that shares
     over half of the article is a copy and tells nothing.  What only some pages repeat, or what stands in the middle, stays:
     prose repeats too (without the host's count, 21 of the 2,500 test pages of sf0.1 would lose lines of their text).

Scale: only line hashes travel for the pairing, and a byte a line comes back.  The order is a range partition of (host,
path), so a host with a third of all pages spreads over many tasks; pairs across partition ends are mended by one row an
end.  The text is shuffled once, to meet its flags.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import dropped, partitions, staged

OPEN, ARTICLE, CHROME = 0, 1, 2
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
#: Elements whose content is no text.
SILENT = frozenset("script style noscript template iframe object embed svg canvas title audio video map".split())
#: Elements that are chrome wherever they stand.
CHROME_TAGS = frozenset("nav footer aside form button select textarea dialog menu fieldset input label datalist".split())
#: Words of class and id names that mark chrome.
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense banner sponsor sponsored sponsors promo promoted "
    "promotion cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar sidebars sidenav widget widgets footer masthead "
    "topbar toolbar comment comments commentlist disqus reply replies respond discussion share sharing social related recommended "
    "recommendations trending login search skip skiplink copyright legal alert disclaimer".split())
#: Words of layout: a name made up of chrome and layout words only ("site-notice", "ad-box") marks chrome inside an article, any other
#: word makes it the name of content ("tasting-menu", "newsletter-history").
LAYOUT_NAMES = frozenset(
    "box container wrapper wrap inner outer list block section area bar row col column unit slot site page post posts article articles "
    "label top bottom left right main global link links item items icon icons button buttons form panel group module count".split())
#: Words that may follow a chrome word, but do not stand before it ("comment-text", not "text-overlay").
FOLLOWING_NAMES = frozenset("text content body author meta date title heading header cta media network networks policy this now stories news topics close image".split())
#: Words that are also titles: on a paragraph, a heading or a section of an article they mark nothing as an id, nor these as a class.
TITLE_IDS = frozenset(
    "alert banner copyright discussion disclaimer footer legal login masthead notice notices promotion related recommendations recommended "
    "replies reply respond search sharing skip social subscription toolbar trending".split())
TITLE_CLASSES = TITLE_IDS - frozenset("alert banner promotion related recommended sharing social".split())
PROSE_TAGS = frozenset("p section h1 h2 h3 h4 h5 h6 li dt dd blockquote figure figcaption".split())
COMMENT_NAMES = frozenset("comment comments reply replies".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements that end the block before them and start a new one.
BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside "
    "blockquote pre figure figcaption address hr form fieldset legend details summary body html dialog menu center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - {"body", "html"}
NAME = re.compile(r"[a-z0-9]+")


def _only_chrome(words: list[str]) -> bool:
    """Do the words of one name speak of chrome and layout only?"""
    words = [w.rstrip("0123456789") for w in words]
    chrome = [w in CHROME_NAMES for w in words]
    rest = LAYOUT_NAMES | FOLLOWING_NAMES if chrome[:1] == [True] else LAYOUT_NAMES
    return any(chrome) and all(c or not w or w in rest for w, c in zip(words, chrome))


def _named_chrome(tag: str, name: str, value: str, inside: bool) -> bool:
    """Does a class or id mark chrome?  Outside an article any chrome word does; inside it, a name of chrome and layout words only."""
    if not inside:
        return not CHROME_NAMES.isdisjoint(NAME.findall(value))
    titles = (TITLE_CLASSES if name == "class" else TITLE_IDS) if tag in PROSE_TAGS else frozenset()
    return any(_only_chrome(NAME.findall(v)) for v in value.split() if v not in titles)


def _zone(tag: str, attrs: str, outer: int) -> int:
    """Zone of the lines inside an element, given that of its parent."""
    if outer == CHROME or (tag in CHROME_TAGS and not (tag == "label" and outer == ARTICLE)):
        return CHROME
    if attrs.strip():
        for name, a, b, c in ATTR.findall(attrs):
            name, value = name.lower(), html.unescape(a or b or c).lower()
            if name in ("class", "id"):
                if tag in ("main", "article"):  # a comment or a teaser as an article of its own
                    if (outer == ARTICLE or not COMMENT_NAMES.isdisjoint(NAME.findall(value))) and _named_chrome(tag, name, value, True):
                        return CHROME
                elif tag not in ("body", "html") and _named_chrome(tag, name, value, outer == ARTICLE):
                    return CHROME
                if value.strip() in ("site-header", "page-header") or (outer != ARTICLE and value.strip() == "header"):
                    return CHROME
            elif name == "role":
                if value in CHROME_ROLES:
                    return CHROME
                if value == "main" or value == "article":
                    outer = ARTICLE
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                return CHROME
            elif name == "itemprop" and value == "articlebody":
                outer = ARTICLE
    if tag == "header" and outer != ARTICLE:
        return CHROME
    return ARTICLE if tag in ("article", "main") else outer


class _Lines:
    """Text lines of a page while its tags are read: a stack of open elements and the text of the block at hand."""

    def __init__(self):
        self.lines: list[str] = []
        self.zones: list[int] = []
        self.stack: list[tuple[str, int, list[str] | None]] = []  # element, zone, text of the block that it stands in
        self.parts: list[str] = []
        self.zone = OPEN

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            self.parts.clear()
            if text:
                self.lines.append(text)
                self.zones.append(self.zone)

    def close(self, k: int) -> None:
        """End element ``k`` of the stack and all inside it; text of an inline element of another zone is a line of its own."""
        while len(self.stack) > k:
            tag, _, around = self.stack.pop()
            outer = self.stack[-1][1] if self.stack else OPEN
            if outer != self.zone or tag in BLOCKS:
                self.flush()
            if around is not None:
                self.parts = around
            self.zone = outer

    def open(self, tag: str, attrs: str) -> None:
        inner, around = _zone(tag, attrs, self.zone), None
        if inner != self.zone:
            if tag in BLOCKS:
                self.flush()
            else:  # a button or an advert in running text: the text around it goes on behind it
                around, self.parts = self.parts, []
        self.stack.append((tag, inner, around))
        self.zone = inner

    def innermost(self, tag: str, barrier: frozenset) -> int | None:
        """The innermost open ``tag`` that no open element of ``barrier`` hides."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                return k
            if self.stack[k][0] in barrier:
                return None
        return None


NOTHING: frozenset = frozenset()


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The text lines of a page in order with their zones; white space inside a line is one space, references are decoded.

    Start tags that need no end tag (p, li, head) end where HTML ends them; a silent element without an end tag ends at the
    next tag, so nothing behind it is lost.
    """
    out, at, size = _Lines(), 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            out.parts.append(page[at:])
            break
        if m.start() > at:
            out.parts.append(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag in BLOCKS:
                out.flush()
            k = out.innermost(tag, NOTHING if tag in BLOCKS else BLOCKS)  # an inline end tag closes no block
            if k is not None:
                out.close(k)
            continue
        if tag in SILENT:
            if not m.group(3).rstrip().endswith("/") and tag not in VOID:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at) or TAG.search(page, at)
                at = size if end is None else end.end() if end.group().lower().startswith(f"</{tag}") else end.start()
            continue
        if tag in BLOCKS:
            out.flush()
            if tag in ENDS_P and (k := out.innermost("p", BLOCKS - {"p"})) is not None:
                out.close(k)
            if tag in ("li", "option") and out.stack and out.stack[-1][0] == tag:
                out.close(len(out.stack) - 1)
            if tag == "body" and out.stack and out.stack[-1][0] == "head":
                out.close(len(out.stack) - 1)
        elif tag == "br":
            out.parts.append(" ")
        if tag not in VOID:
            out.open(tag, m.group(3))
    out.close(0)
    out.flush()
    return out.lines, out.zones


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; query and fragment do not count, nor do scheme, port and a trailing slash."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)", (url or "").strip())
    return (m.group(1).lower(), m.group(2).rstrip("/")) if m else ("", (url or "").split("?")[0].split("#")[0])


def shared_lines(a: list[int], b: list[int], bits: int = 1 << 28) -> list[bool]:
    """Which items of ``a`` belong to a longest common subsequence with ``b`` (bit-parallel, halved when large)."""
    n, head = len(a), 0
    while head < min(n, len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, len(b)) - head and a[n - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    x, y = a[head:n - tail], b[head:len(b) - tail]
    return [True] * head + _lcs(x, y, bits) + [True] * tail


def _rows(x: list[int], y: list[int]):
    """The bit vectors of the dynamic programme after each item of x: zeros mark columns where the length grows."""
    where: dict[int, int] = {}
    for k, item in enumerate(y):
        where[item] = where.get(item, 0) | 1 << k
    full = (1 << len(y)) - 1
    v = full
    for item in x:
        u = v & where.get(item, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(v: int, m: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(v.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _lcs(x: list[int], y: list[int], bits: int) -> list[bool]:
    if not x or not y:
        return [False] * len(x)
    if len(x) * len(y) > bits and len(x) > 1:
        half = len(x) // 2
        *_, v = _rows(x[:half], y)
        *_, w = _rows(x[half:][::-1], y[::-1])
        cut = int(np.argmax(_lengths(v, len(y)) + _lengths(w, len(y))[::-1]))
        return _lcs(x[:half], y[:cut], bits) + _lcs(x[half:], y[cut:], bits)
    vs, out, j = list(_rows(x, y)), [False] * len(x), len(y)
    full = (1 << len(y)) - 1
    for i in range(len(x) - 1, -1, -1):
        # the last growing column below j; the row above grows there too unless item i made it
        while j > 0 and vs[i] >> (j - 1) & 1:
            j -= 1
        if j == 0:
            break
        above = vs[i - 1] if i else full
        if above >> (j - 1) & 1:
            out[i] = True
            j -= 1
    return out


def _hashes(lines: list[str], zones: list[int]) -> list[int]:
    """64-bit hashes of lines with their zone in the low two bits."""
    return [((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 2 << 2) | z) - (1 << 63) for x, z in zip(lines, zones)]


#: Flags of a line: the nearest neighbour shares it; both do, neither is a copy of the article, and the line is common on the host.
NEAREST, BOTH = 1, 2
#: Pages, and the share of a host's pages, whose articles must hold a common line.
COMMON_PAGES, COMMON_SHARE = 3, 0.5
#: Tasks over which the pages of one host spread at most, when they meet their host's common lines.
SALTS = 32


def shared_flags(own: list[int], sides: list[tuple[str, list[int]]], path: str, common: set[int]) -> bytes:
    """Flags of each line of a page, given (path, line hashes) of its neighbours; of equally near ones the first counts.

    common: article lines of the page's host that are common there.
    """
    sides = [s for s in sides if s[1] != own]
    if not sides:
        return bytes(len(own))
    aligned = [shared_lines(own, s[1]) for s in sides]
    nearest = max(range(len(sides)), key=lambda k: _common(sides[k][0], path))
    article = [k for k, h in enumerate(own) if h & 3 == ARTICLE]
    both = common and len(sides) == 2 and all(2 * sum(a[k] for k in article) <= len(article) for a in aligned)
    return bytes(NEAREST * aligned[nearest][k] | (BOTH if both and own[k] in common and aligned[0][k] and aligned[1][k] else 0) for k in range(len(own)))


#: Open text of its own over that many times as long as the declared articles is the text, the articles are teasers.
TEASERS = 2


def content_zone(lines: list[str], zones: list[int], shared: list[bool]) -> int:
    """The zone of the main text: the declared article, unless lines that no neighbour shares outweigh it outside."""
    size = {z: sum(len(x) for x, y, f in zip(lines, zones, shared) if y == z and not (f and z == OPEN)) for z in (ARTICLE, OPEN)}
    return ARTICLE if ARTICLE in zones and size[OPEN] <= TEASERS * size[ARTICLE] else OPEN


def main_text(lines: list[str], zones: list[int], flags: bytes) -> list[str]:
    """Lines that stay: first go those that the flags tell to be template (see above), then those outside the zone of the text.

    A neighbour that shares every open line tells nothing of a template: all open lines stay.
    """
    zone = content_zone(lines, zones, [bool(f & NEAREST) for f in flags])
    bit = BOTH if zone == ARTICLE else NEAREST
    rows = [(x, f & bit) for x, z, f in zip(lines, zones, flags) if z == zone]
    own = [k for k, (_, f) in enumerate(rows) if not f] or [0, len(rows) - 1]
    return [x for x, _ in rows[own[0]:own[-1] + 1]]


def _common(a: str, b: str) -> int:
    """Length of the common prefix of two paths."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _keys(batches):
    for batch in batches:
        url, page = (batch.column(k).to_pylist() for k in (1, 2))
        keys = [url_key(u) for u in url]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([_hashes(*lines_of(p)) for p in page], pa.list_(pa.int64()))], names=["rid", "host", "path", "hashes"])


RESULT = "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_template long, n_differenced long, n_zoned long"


def _aligned(batches):
    """A byte of flags for each line of a page that has a neighbour."""
    for batch in batches:
        out = []
        for path, hashes, common, *sides in zip(*[c.to_pylist() for c in batch.columns[1:]]):
            out.append(shared_flags(hashes, [(s["path"], s["hashes"]) for s in sides if s is not None], path, set(common or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rid", "flags"])


def _extract(batches):
    for batch in batches:
        out = [[] for _ in range(7)]
        for page, flags in zip(*[c.to_pylist() for c in batch.columns[2:]]):
            lines, zones = lines_of(page)
            flags = flags or bytes(len(lines))
            kept = main_text(lines, zones, flags)
            text, whole = "\n\n".join(kept), main_text(lines, zones, bytes(len(lines)))
            # shared lines that are not in the text fall to the alignment, the other ones that are not there to the zones
            zone = content_zone(lines, zones, [bool(f & NEAREST) for f in flags])
            shared = sum(bool(f & NEAREST) for f in flags)
            differenced = sum(bool(f & NEAREST) for f, z in zip(flags, zones) if z != zone) + len(whole) - len(kept)
            for col, x in zip(out, (text, len(text), len(lines), shared, len(whole) - len(kept), differenced, len(lines) - len(kept) - differenced)):
                col.append(x)
        types = (pa.string(), *[pa.int64()] * 6)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, t) for c, t in zip(out, types)]],
                                         names=[f.split()[0] for f in RESULT.split(", ")])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, n_lines, n_shared, n_template,
    n_differenced, n_zoned.

    n_shared: lines of the page, in any zone, that its nearest neighbour shares; n_template: lines of the text's zone that the differencing
    took out; n_differenced: all lines that it takes out, wherever they stand; n_zoned: the lines that go by their zone alone.
    Blocks are joined by an empty line; null html counts as empty (text empty); a null or odd URL is a host of its
    own kind ('').  Identical rows count as one page when pages are paired and each gives a row; a page alone on its
    host shares nothing.  Other columns are ignored; an empty table gives an empty result.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("rid", F.unhex(F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("-")),
                                                               F.coalesce("url", F.lit("\x1e")), "html"), 256), 1, 32)))
    keyed_raw = staged(src.select("rid", "url", "html").mapInArrow(_keys, "rid binary, host string, path string, hashes array<long>"), "page-keys")
    order = ["host", "path", "rid"]
    keyed = keyed_raw.groupBy(*order).agg(F.min("hashes").alias("hashes"))
    placed = staged(keyed.repartitionByRange(partitions(pages.sparkSession), *order).withColumn("part", F.spark_partition_id()), "page-order")
    dropped(keyed_raw)
    me = F.struct("host", "path", "hashes")
    by = Window.partitionBy("part").orderBy(*order)
    placed_by = placed.withColumn("prev", F.lag(me).over(by)).withColumn("next", F.lead(me).over(by))
    rank = F.struct(*order)
    ends = placed.groupBy("part").agg(F.min_by(me, rank).alias("low"), F.max_by(me, rank).alias("high"))
    along = Window.orderBy("part")  # one row a partition
    ends = ends.select("part", F.lag("high").over(along).alias("before"), F.lead("low").over(along).alias("after"))
    # article lines that are common on their host: a few for each host, however many pages it has
    each = placed.select("host", F.explode(F.array_distinct(F.filter("hashes", lambda h: h.bitwiseAND(F.lit(3)) == ARTICLE))).alias("h"))
    lines = each.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_PAGES)
    sizes = placed.groupBy("host").agg(F.count("*").alias("pages"))
    common = (lines.join(sizes, "host").filter(F.col("n") >= F.col("pages") * COMMON_SHARE)
              .groupBy(F.col("host").alias("_host")).agg(F.collect_set("h").alias("common")))
    near = placed_by.join(ends, "part", "left").filter(F.coalesce("prev", "before", "next", "after").isNotNull())
    # a host's pages spread over SALTS tasks to meet its few common lines
    common = common.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = near.withColumn("_salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    near = near.join(common, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_part")), "left").select(
        "rid", "path", "hashes", "common", *[F.when(F.coalesce(a, b)["host"] == F.col("host"), F.coalesce(a, b)).alias(c)
                                   for a, b, c in (("prev", "before", "prev"), ("next", "after", "next"))])
    flags = staged(near.filter("prev is not null or next is not null").mapInArrow(_aligned, "rid binary, flags binary"), "page-flags")
    dropped(placed)
    # merged, not broadcast: there is a row of flags for each page
    return src.join(flags.hint("merge"), "rid", "left").select("page_id", "url", "html", "flags").mapInArrow(_extract, RESULT)


def brute_force(pages: list[tuple[int, str | None, str | None]]) -> dict[int, str]:
    """Texts by page id for pages of different ids: neighbours from one sorted list, lines aligned by the plain table of the
    dynamic programme (for tests)."""
    rows = []
    for page_id, url, page in pages:
        lines, zones = lines_of(page or "")
        rows.append((*url_key(url), _hashes(lines, zones), page_id, lines, zones))

    def aligned(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        out, i, j = [False] * len(x), len(x), len(y)
        while i and j:
            if best[i][j] == best[i][j - 1]:
                j -= 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out[i] = True
        return out

    texts, rows, seen = {}, sorted(rows, key=lambda r: (r[0], r[1], r[3])), {}
    for host, _, own, *_ in rows:
        for h in set(own):
            seen[host, h] = seen.get((host, h), 0) + 1
    pages_of = {host: sum(r[0] == host for r in rows) for host, *_ in rows}
    for k, (host, path, own, page_id, lines, zones) in enumerate(rows):
        sides = [rows[i] for i in (k - 1, k + 1) if 0 <= i < len(rows) and rows[i][0] == host and rows[i][2] != own]
        shares = [aligned(own, s[2]) for s in sides]
        near = max(range(len(sides)), key=lambda i: _common(sides[i][1], path), default=None)
        content = content_zone(lines, zones, [False] * len(own) if near is None else shares[near])
        at = [i for i, z in enumerate(zones) if z == content]
        if content == ARTICLE:
            known = len(sides) == 2 and all(2 * sum(a[i] for i in at) <= len(at) for a in shares)
            common = [seen[host, own[i]] >= max(COMMON_PAGES, COMMON_SHARE * pages_of[host]) for i in at]
            gone = [known and c and all(a[i] for a in shares) for i, c in zip(at, common)]
        else:
            gone = [near is not None and shares[near][i] for i in at]
        if at and not all(gone):
            while gone[0]:
                del gone[0], at[0]
            while gone[-1]:
                del gone[-1], at[-1]
        texts[page_id] = "\n\n".join(lines[i] for i in at)
    return texts
