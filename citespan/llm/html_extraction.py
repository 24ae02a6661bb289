"""Main text of web pages by a site style tree.

A page is parsed once into block elements and the texts that stand directly in them.  An element's *style*
is its path of block tags with their class and id names.  All pages of a host, with an article or without,
are merged by style into the host's style tree, and each node gets

* a presentation importance: how much the pages differ in what the branch is made of (entropy of its
  distinct shapes over the pages that have it, 1 if all differ, 0 if all are the same);
* a content importance: the same over the branch's distinct texts.

A branch of low combined importance belongs to the template and is removed from each page.  Pages count by
their main text: copies of one story, whatever menus and adverts stand round them, are one page, so a
story that many pages print is no template.  Inside an article a branch goes only if nearly all articles of
the host hold it unchanged (``INSIDE``).

Menus and adverts that differ from page to page and template parts of hosts with few pages leave no
trace in the tree, so some branches have a fixed importance of 0: elements that stand for menus,
headers, footers, sidebars, forms and scripts, and those whose class or id is made of names for such
parts, notices, adverts and comments.  Of what is left, a page's article or main element is its text; where
there is none, or it holds less than a quarter of what stands beside it, all that is left is.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Pages of a host that must have a branch before it can be removed, and the importance below which it is.
LEAST_PAGES, LEAST_IMPORTANCE = 3, 0.5
#: The same for branches inside an article, and the part of the host's pages that must have them.
INSIDE_PAGES, INSIDE_IMPORTANCE, INSIDE_PART = 10, 0.1, 0.5
#: Weight of the presentation importance against the content importance.
PRESENTATION = 0.2
#: Branches of low importance that are sent to all executors at most (8 bytes each, and a host's name).
SENT_BRANCHES = 200_000
#: An article is taken for a page's text if what is left beside it is at most so many times as long.
BESIDE = 3

# HTML's element classes, and names that web pages use for what isn't the article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
_DROP = frozenset("nav footer aside script style noscript template textarea title iframe head dialog menu button select option svg canvas object embed noembed noframes xmp video audio fieldset".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_MAIN = frozenset(("article", "main"))
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table div section article main aside nav header footer body td th blockquote form".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login comment comments commentlist reply replies disqus respond share sharing social related recommended "
    "recommendations pagination pager toolbar legal copyright disclaimer search form skip".split()
)
_NEUTRAL_WORDS = frozenset(
    "site page main top bottom left right upper lower global primary secondary sub box list section container wrapper wrap inner outer block area slot bar row col item items links link unit group panel "
    "content region zone the post posts entry article articles blog story user reader readers my fixed sticky mobile desktop icon icons button buttons policy google x of in a b c d".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

#: Marks of an element: noise whatever it holds, noise by name, form or header, an article or main element,
#: and whether it or an element round it is one.
HARD, SOFT, MAIN, INSIDE = 1, 2, 4, 8


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text else {}


def _named_noise(names: str) -> bool:
    """Whether a class or id is made of noise words and words that say nothing beside them only."""
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in _NOISE_WORDS for w in words) and all(w in _NOISE_WORDS or w in _NEUTRAL_WORDS for w in words):
            return True
    return False


def _marks(tag: str, attrs: dict[str, str], inside: bool) -> int:
    if tag in _DROP or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return HARD
    if attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return HARD
    role = attrs.get("role", "").lower()
    if tag in _MAIN or role == "main":
        return MAIN
    if tag in ("body", "html"):
        return 0
    if role in _NOISE_ROLES or tag == "form" or tag == "header" and not inside:
        return SOFT
    return SOFT if attrs and _named_noise(f"{attrs.get('class', '')} {attrs.get('id', '')}") else 0


def _style(tag: str, attrs: dict[str, str]) -> str:
    return ".".join([tag, *sorted(attrs.get("class", "").split())]) + (f"#{attrs['id']}" if attrs.get("id") else "")


def _step(path: bytes, style: str) -> bytes:
    return xxhash.xxh3_64_digest(path + b"/" + style.encode())


def branch_of(style: str) -> int:
    """The branch of a path of tags with their names, as ``html/body/div.top.wide#logo``."""
    path = b""
    for step in style.split("/"):
        path = _step(path, step)
    return _signed(int.from_bytes(path, "big"))


class Page:
    """A page's block elements, each after the one it stands in, and its texts in page order.

    parents, marks, styles: of each element, styles without what is above it; ``branches`` are hashes of
    whole styles (``branch_of``).  owners, texts: each block of text and the element it stands in.
    """

    def __init__(self):
        self.parents, self.marks, self.styles, self.owners, self.texts = [-1], [0], [""], [], []

    def packed(self) -> bytes:
        """The page as one compressed value; branches follow from the styles."""
        return zstandard.ZstdCompressor(level=6, write_checksum=False, write_content_size=True).compress(json.dumps([self.parents, self.marks, self.styles, self.owners, self.texts], ensure_ascii=False, separators=(",", ":")).encode())

    @classmethod
    def unpacked(cls, blob: bytes) -> Page:
        page = cls()
        page.parents, page.marks, page.styles, page.owners, page.texts = json.loads(zstandard.ZstdDecompressor().decompress(blob))
        return page

    def branches(self) -> list[int]:
        paths: list[bytes] = [b""]
        known: dict[tuple[bytes, str], bytes] = {}
        for p, style in zip(self.parents[1:], self.styles[1:]):
            at = paths[p], style
            if at not in known:
                known[at] = _step(*at)
            paths.append(known[at])
        return [_signed(int.from_bytes(p, "big")) for p in paths]

    def noise(self) -> list[bool]:
        """Of each element, whether its importance is 0 by its name or by an element's round it.

        An element that is noise by name only isn't, if the page's only articles stand in it, or, on a page
        without any, if it holds more than half of the text.
        """
        n = len(self.parents)
        size = [0] * n
        for o, t in zip(self.owners, self.texts):
            size[o] += len(t)
        hard, noise = [False] * n, [False] * n
        for i in range(1, n):
            hard[i] = hard[self.parents[i]] or self.marks[i] & HARD > 0
            noise[i] = noise[self.parents[i]] or self.marks[i] & (HARD | SOFT) > 0
        mains = [i for i in range(1, n) if self.marks[i] & MAIN and not hard[i]]
        if any(not noise[i] for i in mains) or not any(m & SOFT for m in self.marks):
            return noise
        for i in range(n - 1, 0, -1):
            if not hard[i]:
                size[self.parents[i]] += size[i]
        spared = set()
        if mains:
            i = max(mains, key=lambda i: (size[i], -i))
            while i > 0:
                spared.add(i)
                i = self.parents[i]
        else:
            spared = {i for i in range(1, n) if 2 * size[i] > size[0]}
        for i in range(1, n):
            noise[i] = noise[self.parents[i]] or self.marks[i] & HARD > 0 or self.marks[i] & SOFT > 0 and i not in spared
        return noise

    def main_texts(self, low: set[int] | frozenset[int] = frozenset()) -> list[str]:
        """The blocks of the main text; low: branches of low importance."""
        gone = self.noise()
        if low:
            branches = self.branches()
            for i in range(1, len(gone)):
                gone[i] = gone[i] or gone[self.parents[i]] or branches[i] in low and not self.marks[i] & MAIN
        left = [(self.marks[o] & INSIDE > 0, t) for o, t in zip(self.owners, self.texts) if not gone[o]]
        inside, beside = (sum(len(t) for i, t in left if i == part) for part in (True, False))
        if inside * BESIDE >= beside and any(m & MAIN for m, g in zip(self.marks, gone) if not g):
            return [t for i, t in left if i]
        return [t for _, t in left]

    def folded(self) -> list[tuple[int, int, int, bool]]:
        """(branch, hash of its texts, hash of its shape, whether it is inside an article) of each branch."""
        n, branches = len(self.parents), self.branches()
        h = xxhash.xxh3_64_intdigest
        content, shape = [b""] * n, [b""] * n
        parts: list[list[bytes]] = [[] for _ in range(n)]
        texts: list[list[str]] = [[] for _ in range(n)]
        for o, t in zip(self.owners, self.texts):
            texts[o].append(t)
        for i in range(n - 1, -1, -1):  # children have larger numbers
            own = "\n".join(texts[i]).encode()
            kids = parts[i][::-1]
            if own or kids:
                content[i] = h(own + b"\0" + b"".join(k[:8] for k in kids)).to_bytes(8, "big")
                shape[i] = h(bytes([bool(own)]) + b"".join(k[8:] for k in kids)).to_bytes(8, "big")
                if i:
                    parts[self.parents[i]].append(content[i] + (branches[i] & (1 << 64) - 1).to_bytes(8, "big") + shape[i])
        found: dict[int, list] = {}
        for i in range(1, n):
            if content[i]:
                at = found.setdefault(branches[i], [b"", b"", self.marks[i] & INSIDE > 0])
                at[0] += content[i]
                at[1] += shape[i]
        return [(b, _signed(h(c)), _signed(h(s)), inside) for b, (c, s, inside) in found.items()]

    def identity(self) -> int:
        return _signed(xxhash.xxh3_64_intdigest("\n".join(self.main_texts())))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class _Open:
    """An open element: its tag, its block element's number, whether its own words are noise."""

    __slots__ = ("tag", "number", "skip")

    def __init__(self, tag: str, number: int, skip: bool):
        self.tag, self.number, self.skip = tag, number, skip


class _Stack(list):
    """The open elements, and where those of each tag and kind stand, so that an end finds its start at once."""

    def __init__(self):
        super().__init__([_Open("", 0, False)])
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self.scopes: list[int] = [0]
        self.rows: list[int] = [0]  # scopes but cells
        self.mains: list[int] = [0]
        self.lists: dict[str, list[list[int]]] = {}

    def _of(self, tag: str) -> list[list[int]]:
        """The lists that an element with this tag stands in."""
        if tag not in self.lists:
            kinds = (self.blocks, tag in _BLOCK), (self.scopes, tag in _SCOPES), (self.rows, tag in _SCOPES and tag not in ("td", "th")), (self.mains, tag in _MAIN)
            self.lists[tag] = [self.places.setdefault(tag, []), *(of for of, here in kinds if here)]
        return self.lists[tag]

    def push(self, item: _Open) -> None:
        n = len(self)
        for of in self.lists.get(item.tag) or self._of(item.tag):
            of.append(n)
        self.append(item)

    def drop(self) -> None:
        for of in self.lists[self.pop().tag]:
            of.pop()

    def last(self, *tags: str) -> int:
        """Where the innermost element with one of these tags stands; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


class _Marks:
    """The next mark of markup from a place on, in time linear in the page."""

    def __init__(self, text: str):
        self.text, self.never, self.plain = text, {}, False

    def find(self, what: str, at: int) -> int:
        """Where ``what`` stands next; -1 if nowhere, which is remembered."""
        if at >= self.never.get(what, len(self.text) + 1):
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.never[what] = at
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose names end at ``at``: at the next > outside of quotes; -1 if it never does.
        Once quotes have led to the page's end without one, tags end at the next > whatever is quoted."""
        start = at
        while not self.plain:
            end = self.find(">", at)
            if end < 0:
                break
            if at == start:
                between = self.text[at:end]
                if "'" not in between and between.count('"') % 2 == 0:
                    return end
            quote = min((q for q in (self.text.find('"', at, end), self.text.find("'", at, end)) if q >= 0), default=-1)
            if quote < 0:
                return end
            closed = self.find(self.text[quote], quote + 1)
            if closed < 0:
                break
            at = closed + 1
        if self.find(">", start) >= 0:
            self.plain = True
        return self.find(">", start)


def _raw_end(text: str, tag: str, at: int, marks: _Marks) -> int:
    """Where what follows an element of raw text begins; the page's end if it is never closed."""
    name = f"</{tag}"
    if at >= marks.never.get(name, len(text) + 1):
        return len(text)
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
    if end is None:
        marks.never[name] = at
    return end.end() if end else len(text)


def parse(html: str | None) -> Page:
    """A page's elements and texts; scripts, styles, comments and markup are left out.

    Unclosed elements end as HTML says: a paragraph at the next block, a list item at the next one, all
    at the end; a tag that isn't closed is none, and what follows it is left out.  Time is linear in the page's
    length, however broken it is.
    """
    page = Page()
    stack = _Stack()
    words: list[str] = []

    def flush():
        text = " ".join("".join(words).split())
        if text:
            page.owners.append(stack[-1].number)
            page.texts.append(text)
        words.clear()

    def close(until: int):
        """Take elements off the stack down to this length."""
        while len(stack) > until:
            if stack[-1].tag in _BLOCK:
                flush()
            stack.drop()

    at, text = 0, html or ""
    n, marks_of = len(text), _Marks(text)
    while at < n:
        if text[at] != "<":
            end = marks_of.find("<", at)
            end = n if end < 0 else end
            if not stack[-1].skip:
                some = text[at:end]
                words.append(entities.unescape(some) if "&" in some else some)
            at = end
            continue
        if text.startswith("<!--", at):
            end = marks_of.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if text.startswith("<![CDATA[", at):
            end = marks_of.find("]]>", at + 9)
            if not stack[-1].skip:
                words.append(text[at + 9 : n if end < 0 else end])
            at = n if end < 0 else end + 3
            continue
        if text.startswith(("<!", "<?"), at):
            end = marks_of.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(text, at)
        if m is None:
            if not stack[-1].skip:
                words.append("<")
            at += 1
            continue
        end = marks_of.tag_end(m.end())
        if end < 0:  # an unclosed tag to the end of the page
            break
        between, at = text[m.end() : end], end + 1
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                words.append(" ")
                continue
            i = stack.last(tag)
            if i and not (tag not in _BLOCK and stack.scopes[-1] > i) and not (tag == "p" and stack.mains[-1] > i):
                close(i)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1].skip:
                words.append(" ")
            continue
        attrs = _attributes(between) if between.strip() else {}
        if tag in _CLOSES_P and stack.last("p") and stack.last("p") == stack.blocks[-1]:
            close(stack.last("p"))
        if tag in _CLOSED_BY:
            i = stack.last(*_CLOSED_BY[tag])
            if i and (stack.rows if tag == "tr" else stack.scopes)[-1] <= i:
                close(i)
        if tag in _RAW:
            at = _raw_end(text, tag, at, marks_of)
            continue
        if between.rstrip().endswith("/") and tag not in _BLOCK:
            continue
        top = stack[-1]
        inside = page.marks[top.number] & INSIDE
        marks = _marks(tag, attrs, inside > 0)
        if tag not in _BLOCK:
            stack.push(_Open(tag, top.number, top.skip or marks & (HARD | SOFT) > 0))
            continue
        flush()
        page.parents.append(top.number)
        page.styles.append(_style(tag, attrs))
        # What stands in an inline element that is noise is noise as well.
        marks = marks | (HARD if top.skip else 0)
        page.marks.append(marks | (inside or (INSIDE if marks & MAIN else 0)))
        stack.push(_Open(tag, len(page.parents) - 1, False))
    close(1)
    flush()
    return page


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


PARSED = "page_id long, url string, host string, page binary, identity long"
BRANCHES = "host string, identity long, branch long, content long, shape long, inside boolean"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [parse(html.as_py()) for html in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([p.packed() for p in pages], pa.binary()), pa.array([p.identity() for p in pages], pa.int64())], names=["page_id", "url", "host", "page", "identity"])


def parsed(pages: DataFrame) -> DataFrame:
    """Each row of pages, parsed: its elements and texts as one compressed value, and the hash of its main text."""
    return pages.select(F.col("page_id").cast("long"), "url", _host(F.col("url")).alias("host"), "html").mapInArrow(_parsed, PARSED)


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folded = [Page.unpacked(p.as_py()).folded() for p in batch.column(2)]
        owner = pa.array([i for i, rows in enumerate(folded) for _ in rows], pa.int64())
        columns = list(zip(*(r for rows in folded for r in rows)))
        if columns:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["host", "identity", "branch", "content", "shape", "inside"])


def _entropy(pages, n_log_n):
    """Entropy of parts that sum up to ``pages``, over its largest possible value."""
    return F.when(pages > 1, 1 - n_log_n / pages / F.log(pages)).otherwise(F.lit(1.0))


def style_tree(opened: DataFrame) -> DataFrame:
    """host, branch, inside, pages, host_pages, shape and content importance, importance, of parsed pages.

    Pages with one main text count once; of what else they hold, the least hash of each branch stands for
    all.  Rows are summed by page, then by content, before they are summed by branch, so a host with a third
    of all pages is many small groups.
    """
    rows = opened.select("host", "identity", "page").mapInArrow(_branches, BRANCHES)
    once = rows.groupBy("host", "branch", "identity").agg(F.min("content").alias("content"), F.min("shape").alias("shape"), F.max("inside").alias("inside"))
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("is_content"), F.col("content").alias("hash")), F.struct(F.lit(False).alias("is_content"), F.col("shape").alias("hash"))))
    counts = once.select("host", "branch", "inside", kinds.alias("k")).groupBy("host", "branch", "k.is_content", "k.hash").agg(F.count("*").alias("n"), F.max("inside").alias("inside"))
    of = lambda is_content, value: F.sum(F.when(F.col("is_content") == is_content, value).otherwise(F.lit(0)))
    n_log_n = F.col("n") * F.log("n")
    sums = counts.groupBy("host", "branch").agg(F.max("inside").alias("inside"), of(True, F.col("n")).alias("pages"), of(True, n_log_n).alias("c"), of(False, n_log_n).alias("s"))
    hosts = opened.select("host", "identity").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    tree = sums.join(hosts, "host").select("host", "branch", "inside", "pages", "host_pages", _entropy(F.col("pages"), F.col("c")).alias("content_importance"), _entropy(F.col("pages"), F.col("s")).alias("shape_importance"))
    return tree.withColumn("importance", PRESENTATION * F.col("shape_importance") + (1 - PRESENTATION) * F.col("content_importance"))


def low_branches(tree: DataFrame) -> DataFrame:
    """host, branch of the style tree's template."""
    inside = (F.col("pages") >= INSIDE_PAGES) & (F.col("pages") >= INSIDE_PART * F.col("host_pages")) & (F.col("importance") < INSIDE_IMPORTANCE)
    outside = (F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE)
    return tree.filter(F.when(F.col("inside"), inside).otherwise(outside)).select("host", "branch")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages, repeated rows and null columns too.

    A null or empty html has an empty text; pages without a host in their url are those of one host.  Each
    row is judged by its own host and html, whatever its page_id.  Nothing of the text is dropped or cut short
    but the branches named above.  The text of blocks is joined by an empty line.
    """
    opened = cut(parsed(pages))
    low = cut(low_branches(style_tree(opened)).groupBy("host").agg(F.collect_list("branch").alias("low")))
    # A host's template is a few numbers.  A table of few is sent to all; else pages are dealt by host, and
    # those of a host with a third of all pages anew, as the join is skewed.
    few = (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= SENT_BRANCHES
    joined = opened.select("page_id", "url", "host", "page").join(F.broadcast(low) if few else low, "host", "left").select("page_id", "url", "page", "low")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = ["\n\n".join(Page.unpacked(p.as_py()).main_texts(set(c or ()))) for p, c in zip(b.column(2), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(texts, "page_id long, url string, text string")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
