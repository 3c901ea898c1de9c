"""Main text of web pages, with what a site repeats from page to page removed.

First pass: each page's element subtrees are hashed (name, attributes, text, subtrees within), together with a hash of the
page's text outside the subtree. Spark counts, for each host and subtree, in how many different surroundings it occurs, so
copies and recaptures of one page count once. A subtree is template if it has at least MIN_PAGES surroundings and either
MIN_SHARE of the host's different pages or, unless it is a mere text block, MANY of them. A subtree that holds more than
half of a page's text there is never a candidate. Second pass: those subtrees go, with elements whose name, role or class
says that they aren't the article. Where a page marks its main part, text blocks inside that part are never template:
articles may share passages.

A null html is empty and gives an empty text; a null or odd url belongs to no host, and only names and classes decide
there. Repeated rows get a row each. An empty table gives no row; other columns are ignored. Parsing takes time in
proportion to the page, also where tags aren't closed or nested deeply. Counts have no ties to break.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import stored

MIN_PAGES = 5
MIN_SHARE = 0.3
#: So many pages make a subtree template whatever their share of a large host.
MANY = 50
#: A tag from its sign on, quoted values as wholes; and without regard to quotes.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""")
#: A numeric reference of more digits than any character has.
LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9A-Fa-f]{8,});?")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Without these letters, no attribute tells what an element is for.
TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
#: Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in RAW}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "title", "tbody", "tfoot", "thead", "tr", "caption", "legend"}
SPACES = frozenset("br td th option".split())
#: A start tag ends an open element of these names, up to an element that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
INLINE_LIMIT = frozenset("article aside blockquote div footer form header li main nav section table td th ul ol body".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea menu dialog object canvas audio video title input label noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Those of them that go whatever they hold; forms are looked into.
HARD, HARD_ROLES = DROPPED - {"form"}, DROPPED_ROLES - {"form"}
#: Words that tell what an element is for; a class or id tells it if all its words are of these or of AROUND.
DROPPED_WORDS = frozenset("nav navbar navigation menu sidebar footer ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notification announcement popup modal overlay newsletter subscribe subscription share sharing social related recommended breadcrumb breadcrumbs pagination pager comment comments commentlist disqus reply replies respond widget toolbar login signup search skip".split())
#: Words beside them that say where or how: of side-footer, nav-links, post-comments.
AROUND = frozenset("area articles bar bars block blocks body bottom box btn button buttons column container content entry feed footer form global group header holder icons inner item items left link links list main message module more news outer page pane panel post posts primary region right row secondary section side site slot stories story tags thread top unit wrap wrapper zone".split())
#: Of those, what a part marked as main may say of itself and isn't main then; and what is left out however long it is.
NOT_MAIN = frozenset("related recommended comment comments commentlist reply replies respond sponsored promo promotion advert adverts advertisement".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Whole class names or ids of a page's head.
PAGE_NAMES = frozenset("header masthead topbar site-header page-header main-header global-header header-wrapper".split())
#: Whole class names or ids of a main part.
MAIN_NAMES = frozenset("article article-body article-content article-text articlebody post post-body post-content entry entry-content story story-body story-content".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption".split())
CONTAINERS = (BLOCKS | frozenset("td th".split())) - {"html", "body", "article", "main", "title"}


def unescaped(text: str) -> str:
    """text with its character references decoded; one of too many digits stands for no character."""
    if "&" not in text:
        return text
    return entities.unescape(LONG_REFERENCE.sub(lambda m: m.group() if len(m.group().strip("&#xX;").lstrip("0")) < 8 and len(m.group()) < 1000 else "\ufffd", text))


@lru_cache(maxsize=65536)
def purpose(name: str) -> frozenset[str]:
    words = {w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()}
    return frozenset(words & DROPPED_WORDS) if words <= DROPPED_WORDS | AROUND else frozenset()


def purposes(names: set[str]) -> set[str]:
    """The words for which whole class names or ids drop an element."""
    return {w for n in names for w in purpose(n)}


class Page:
    """Elements of a page in order of opening, and the events (open, close, text) that walk through them.

    Without hashed, hashes and sums stay 0, for a page whose subtrees are neither counted nor looked up.
    """

    def __init__(self, html: str | None, hashed: bool = True):
        self.hashed = hashed
        self.names: list[str] = []
        self.attributes: list[str] = []
        self.parents: list[int] = []
        self.hashes: list[int] = []
        self.filled: list[bool] = []
        self.events: list[tuple[int, int | str]] = []
        self.sizes: list[int] = []  # characters of text in an element
        self.sums: list[int] = []  # sum of the hashes of the texts in an element
        self.size = self.sum = 0
        self._parts: list[list[str]] = []
        self._open: list[int] = []
        self._depths: dict[str, list[int]] = {}  # by name, where its open elements are among all open ones
        self._parse(html or "")
        while self._open:
            self._close()

    def _text(self, text: str) -> None:
        if text:
            self.events.append((0, text))
            if self._open and (words := " ".join(text.split())):
                up = self._open[-1]
                self.filled[up] = True
                if self.hashed:
                    self._parts[up].append(words)
                if self.names[up] not in RAW:
                    self.sizes[up] += len(words)
                    self.size += len(words)
                    if self.hashed:
                        mark = xxhash.xxh64_intdigest(words)
                        self.sums[up] += mark
                        self.sum += mark

    def _start(self, name: str, attributes: str) -> None:
        i = len(self.names)
        self.names.append(name)
        self.attributes.append(attributes)
        self.parents.append(self._open[-1] if self._open else -1)
        self.hashes.append(0)
        self.filled.append(False)
        self.sizes.append(0)
        self.sums.append(0)
        self._parts.append([])
        self.events.append((1, i))
        self._depths.setdefault(name, []).append(len(self._open))
        self._open.append(i)

    def _close(self) -> None:
        i = self._open.pop()
        self._depths[self.names[i]].pop()
        self.events.append((-1, i))
        up = self._open[-1] if self._open else -1
        if self.hashed:
            self.hashes[i] = xxhash.xxh64_intdigest("\x1f".join([self.names[i], " ".join(self.attributes[i].split()), *self._parts[i]])) >> 1
            self._parts[i] = []
            if up >= 0:
                self._parts[up].append(f"<{self.hashes[i]}>")
        if up >= 0 and self.filled[i]:
            self.filled[up] = True
            self.sizes[up] += self.sizes[i]
            self.sums[up] += self.sums[i]

    def _close_to(self, names: set[str] | frozenset[str], limits: set[str] | frozenset[str]) -> None:
        """Closes the innermost open element of the names and all in it, unless one of the limits is open within it."""
        deepest = lambda of: max((d[-1] for n in of if (d := self._depths.get(n))), default=-1)
        k = deepest(names)
        if k >= 0 and deepest(limits) <= k:
            while len(self._open) > k:
                self._close()

    def _parse(self, html: str) -> None:
        at, last, quoted = 0, html.rfind(">"), True
        while (begin := html.find("<", at)) >= 0:
            tag, ended, sign, marked = None, -1, html[begin + 1 : begin + 2], False
            if sign == "!" and html.startswith("<!--", begin):
                ended = html.find("-->", begin + 4)
                ended = len(html) if ended < 0 else ended + 3
            elif sign == "!" and (marked := html.startswith("<![CDATA[", begin)):
                ended = html.find("]]>", begin)
                ended = len(html) if ended < 0 else ended + 3
            elif begin < last and sign in ("!", "?"):
                ended = html.find(">", begin) + 1
            elif begin < last:
                tag = TAG.match(html, begin) if quoted else None
                if tag is None and (tag := PLAIN_TAG.match(html, begin)):
                    quoted = False  # a quote is open to the end: look for pairs no more
                ended = tag.end() if tag else -1
            if ended < 0:  # no tag
                self._text(unescaped(html[at : begin + 1]))
                at = begin + 1
                continue
            self._text(unescaped(html[at:begin]))
            if marked:
                self._text(html[begin + 9 : ended].removesuffix("]]>"))
            at = ended
            if tag:
                at = self._tag(html, at, last, tag[1], tag[2].lower(), tag[3])
        self._text(unescaped(html[at:]))

    def _tag(self, html: str, at: int, last: int, closing: str, name: str, attributes: str) -> int:
        """Takes in a tag; where to read on."""
        if closing:
            if self._open and self.names[self._open[-1]] == name:
                self._close()
            elif self._depths.get(name):
                self._close_to({name}, frozenset() if name in BLOCKS and name != "p" else INLINE_LIMIT - {name})
            return at
        if name in CLOSES_P and self._depths.get("p"):
            self._close_to({"p"}, INLINE_LIMIT)
        if name in ENDS:
            self._close_to(*ENDS[name])
        self._start(name, attributes)
        if name in VOID:
            self._close()
        elif name in RAW:
            end = RAW_ENDS[name].search(html, at, last + 1)
            self._text(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
            self._close()
        return at

    def walk(self) -> None:
        """Sets, by element: dropped by name, role or class; main part, or in it; holding a main part.

        A class or id drops an element only as a whole name (ad, nav-links, and not ad-free or with-menu). Neither that nor a
        form or header drops what holds a main part or, outside of one, more than half of the page's text; readers' comments
        go in any case, and related stories unless every main part lies there.
        """
        n = len(self.names)
        self.dropped, self.inside, self.marked, self.holds = ([False] * n for _ in range(4))
        told: list[frozenset[str] | set[str]] = [frozenset()] * n
        soft, hard = [False] * n, [False] * n
        for i, (name, attributes) in enumerate(zip(self.names, self.attributes, strict=True)):
            if not attributes or not TELLING.search(attributes):
                self.marked[i], hard[i], soft[i] = name in ("article", "main"), name in HARD, name in ("form", "header")
                continue
            values = {a.lower(): (v or "").strip("\"'").lower() for a, v in ATTRIBUTE.findall(attributes)}
            whole, role = {*values.get("class", "").split(), values.get("id", "")}, values.get("role", "")
            told[i] = purposes(whole)
            large = 2 * self.sizes[i] > self.size
            marked = name in ("article", "main") or role in ("main", "article") or bool(MAIN_NAMES & whole) and name in ("div", "section", "td") and not told[i]
            self.marked[i] = marked and (large or not told[i] & NOT_MAIN)
            hard[i] = name in HARD or role in HARD_ROLES or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
            soft[i] = name not in ("html", "body") and (name == "form" or role == "form" or bool(told[i]) and not self.marked[i] or not self.marked[i] and (name == "header" or bool(whole & PAGE_NAMES)))
        parts = [int(m) for m in self.marked]  # main parts in each element
        every = sum(parts)
        if every:
            for i in range(n - 1, -1, -1):
                if parts[i] and self.parents[i] >= 0:
                    parts[self.parents[i]] += parts[i]
        for i, up in enumerate(self.parents):
            self.inside[i] = up >= 0 and (self.inside[up] or self.marked[up])
            self.dropped[i] = up >= 0 and self.dropped[up] or hard[i] or soft[i] and not self._stays(i, told[i], parts[i], every)
            self.marked[i] = self.marked[i] and not self.dropped[i]
        if every:
            for i in range(n - 1, -1, -1):
                if (self.marked[i] or self.holds[i]) and self.parents[i] >= 0:
                    self.holds[self.parents[i]] = True

    def _stays(self, i: int, told: frozenset[str] | set[str], parts: int, every: int) -> bool:
        """Whether an element stays that its name, role or class would drop, for what it holds or where it is."""
        if parts > self.marked[i] and not told & READERS and (not told & NOT_MAIN or parts == every):
            return True
        if self.inside[i]:  # a header within the article is its own
            return not told and self.names[i] != "form"
        return 2 * self.sizes[i] > self.size and not told & READERS

    def candidates(self) -> set[tuple[int, int, bool]]:
        """Of subtrees that may be template: hash, hash of the page's text outside, and whether it is a mere text block."""
        self.walk()
        return {(self.hashes[i], (self.sum - self.sums[i]) & (1 << 63) - 1, name in TEXT_BLOCKS) for i, name in enumerate(self.names) if self._may_be_template(i, name)}

    def _may_be_template(self, i: int, name: str) -> bool:
        return name in CONTAINERS and self.filled[i] and not self.marked[i] and not self.holds[i] and not (self.inside[i] and name in TEXT_BLOCKS) and (self.dropped[i] or 2 * self.sizes[i] <= self.size)

    def main_text(self, template: set[int] | frozenset[int] = frozenset()) -> str:
        self.walk()
        main = any(self.marked)
        blocks: list[str] = []
        block: list[str] = []
        skip = -1
        wanted = 0 if main else 1

        def end() -> None:
            if words := " ".join("".join(block).split()):
                blocks.append(words)
            block.clear()

        for kind, x in self.events:
            if kind == 0:
                if skip < 0 and wanted:
                    block.append(x)
                continue
            name = self.names[x]
            if kind == 1:
                if skip < 0 and (self.dropped[x] or self.hashes[x] in template and self._may_be_template(x, name)):
                    skip = x
                wanted += main and self.marked[x]
            if skip < 0 and name in BLOCKS:
                end()
            elif skip < 0 and name in SPACES:
                block.append(" ")
            if kind == -1:
                wanted -= main and self.marked[x]
                if skip == x:
                    skip = -1
                    if name in BLOCKS:
                        end()
        end()
        return "\n".join(blocks)


HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def hosted(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1).alias("host"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY) -> DataFrame:
    """host and template, the hashes of its template subtrees.

    Counts are two steps of partial sums, so a hot host or subtree is no task of its own. Each template is on min_share of
    a host's pages or on many of them, so the list of a host is a small part of its subtrees.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, found = [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(html)
                own = [(None, page.sum & (1 << 63) - 1, False), *page.candidates()]
                found += own
                hosts += [host] * len(own)
            h, rest, block = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(h, pa.int64()), pa.array(rest, pa.int64()), pa.array(block, pa.bool_())], ["host", "h", "rest", "block"])

    known = hosted(pages).where("host != ''").select("host", "html")
    once = known.mapInArrow(hashes, "host string, h long, rest long, block boolean").groupBy("host", "h", "rest").agg(F.min("block").alias("block"))
    counts = stored(once.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("block").alias("block")).where((F.col("n") >= min_pages) | F.col("h").isNull()), "counts")
    sizes = counts.where("h is null").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    often = counts.where("h is not null").join(sizes, F.col("host") == F.col("of")).where((F.col("n") >= F.col("pages") * min_share) | (~F.col("block") & (F.col("n") >= many)))
    return often.groupBy("host").agg(F.sort_array(F.collect_set("h")).alias("template"))


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """A row a page: page_id, url, text."""
    known = hosted(pages).join(stored(templates(pages, min_pages, min_share), "templates").withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = ((html.as_py(), frozenset(t.as_py() or ())) for html, t in zip(b.column(2), b.column(3), strict=True))
            out = [Page(html, hashed=bool(template)).main_text(template) for html, template in pages]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return known.select("page_id", "url", "html", "template").mapInArrow(texts, "page_id long, url string, text string")
