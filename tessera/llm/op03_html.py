"""HTML extraction by consensus host paths.

Each page is parsed once into containers, scored by the running text of their
paragraphs less that of their links. From the best one the choice climbs to the
containers around it that add text of the same article: out to the outermost
article, and on while what is added is more text than links and no other article.
The choice's path - tags and classes from the root, digits generalised - is the
page's vote; Spark sums the votes by host, and every page is extracted again with
its host's winning path, all containers of it. Where the page's own choice lies
around those, they must hold nearly all of its text; where it lies elsewhere on
the page, a share of it. Otherwise, and without that path, the page keeps its own.

Names (of class, id, role) tell what surrounds an article: a name of such words
and neutral ones only, or one that ends in such a word, marks its element. Names
of weak words are weighed: an element that holds more than half of the page's
running text is the article, whatever its name.

Defined results: a null html has no text; menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments are left out by tag, role
or class name; ``br`` is white space within a block; unclosed and stray tags
are mended as a browser would; a null or odd url votes under its own text;
equal votes go to the higher score, then to the first path by name; equal rows
give equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Up to so many hosts the winning paths are broadcast (some 100 bytes each).
MAX_BROADCAST_HOSTS = 200_000
#: Ways a host's pages are dealt where its path is joined by a shuffle.
SALTS = 64
#: The winning path must hold this share of the text of the page's own choice, if that lies elsewhere, and if it lies around it.
LEAST_SHARE, NEARLY_ALL = 0.25, 0.9

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>|<[!?/][^>]*+>""", re.S)
ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Tags whose content is no article.
LEFT_OUT = RAW | set("nav header footer aside form button select option input fieldset menu dialog head object audio video canvas map search".split())
CONTAINER = set("article main section div td body blockquote center".split())
CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary"}
#: Name parts (of class, id, role) that mark what surrounds an article, and those that may also stand in an article's name.
AROUND = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors "
    "nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager header masthead topbar toolbar footer foot colophon copyright "
    "sidebar sidebars aside complementary contentinfo cookie cookies consent gdpr popup modal overlay paywall disclaimer "
    "newsletter subscribe subscription signup login search comment comments commentlist discussion replies respond responses disqus "
    "share sharing social tagcloud".split()
)
#: Of these, names of what consists of links or controls: an element of an article that holds none is text that is called so.
LINKED = set("nav navigation menu menus submenu share sharing social search login tagcloud breadcrumb breadcrumbs pagination pager toolbar".split())
CONTROLS = set("a button form input select option textarea iframe svg nav".split())
WEAK = set("promo promos promotion promoted side widget widgets notice notices alert register form forms reply reader related recommended recommendations recirc trending popular tags skip hidden".split())
#: Name parts that say nothing of what an element holds.
NEUTRAL = set(
    "list lists box block blocks container containers wrapper wrap section sections area areas region zone left right top bottom center middle main upper lower inner outer bar panel pane link links "
    "content contents body col column columns row rows grid unit units slot slots site page global post posts item items group info text message messages label labels title icon icons count meta widget button buttons btn "
    "js ui view block module component element the and primary secondary mobile desktop small large mini bg first last new article articles entry story".split()
)
#: Before a name part, these say that it is not there or only beside the element.
BESIDE = set("no not non has have with without is".split())
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return (m[1] if m else url or "").lower()


def _around(attrs: dict[str, str]) -> int:
    """2: what surrounds an article; 3: so if it holds links or controls; 1: weakly so; 0: nothing is said."""
    found = 0
    for v in attrs.values():
        for name in v.split():
            parts = [x.lower() for x in _PART.findall(name)]
            told = [x for x in parts if x in AROUND or x in WEAK]
            if not told or BESIDE & set(parts):
                continue
            if parts[-1] in told or all(x in told or x in NEUTRAL for x in parts):
                found = max(found, (1, 3, 2)[sum(x in AROUND for x in told) and 1 + any(x in AROUND - LINKED for x in told)], key=(0, 1, 3, 2).index)
    return found


_steps: dict[tuple[str, str], tuple[str, int]] = {}
_paths: dict[tuple[str, str], str] = {}


def _remember(memo: dict, key: tuple, value):
    if len(memo) >= 20_000:
        memo.clear()
    if sum(map(len, key)) < 500:
        memo[key] = value
    return value


class Page:
    """Containers and text of one page, in document order."""

    def __init__(self, source: str):
        #: events: (node, text), or (node, None) where a block begins or ends
        self.events: list[tuple[int, str | None]] = []
        self.tag, self.parent, self.path, self.score = ["#root"], [-1], [""], [0.0]
        #: 2: left out by tag or name, 3: by a name of links, 1: by a weak name, 0: not; of the element itself, and (once rated) with those around it
        self.mark, self.out = [0], [False]
        self.first, self.last = [0], [0]
        stack = [0]
        at, n = 0, len(source)

        def close(node: int) -> None:
            self.last[node] = len(self.events)

        def pop_to(k: int) -> None:
            while len(stack) > k:
                x = stack.pop()
                if self.tag[x] in BLOCK:
                    self.events.append((stack[-1], None))
                close(x)

        while at < n:
            m = TAG.search(source, at)
            if not m:
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:  # an end tag closes the nearest of its name, if that is open
                k = len(stack) - 1
                while k > 0 and self.tag[stack[k]] != name:
                    # inline tags don't reach out of their block's cell or body
                    if name not in BLOCK and self.tag[stack[k]] in ("td", "th", "body", "article", "section", "main"):
                        k = 0
                        break
                    k -= 1
                if k > 0:
                    pop_to(k)
                continue
            rest = m[3] or m[6] or ""
            if name == "br":
                self._text(stack[-1], " ")
                continue
            if name in CLOSES_P:
                self._close_open(stack, pop_to, {"p"}, {"td", "th", "body", "table"} | (CONTAINER - {"center"}) | {"li", "dd"})
            if name == "li":
                self._close_open(stack, pop_to, {"li"}, {"ul", "ol", "menu", "td", "th", "body"})
            elif name in ("dt", "dd"):
                self._close_open(stack, pop_to, {"dt", "dd"}, {"dl", "body"})
            elif name in ("td", "th"):
                self._close_open(stack, pop_to, {"td", "th"}, {"tr", "table", "body"})
            elif name == "tr":
                self._close_open(stack, pop_to, {"tr"}, {"table", "body"})
            elif name == "body":
                self._close_open(stack, pop_to, {"head"}, {"body"})
            if name in VOID or rest.endswith("/") and name not in BLOCK and name not in RAW:
                if name in BLOCK:
                    self.events.append((stack[-1], None))
                continue
            node = self._open(stack[-1], name, rest)
            if name in BLOCK:
                self.events.append((node, None))
            self.first[node] = len(self.events)
            if name in RAW:  # up to its own end tag all is text, and left out
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = end.end() if end else n
                close(node)
                continue
            stack.append(node)
        pop_to(1)
        self.last[0] = len(self.events)
        self._rate()

    def _close_open(self, stack, pop_to, names: set, stop: set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                pop_to(k)
                return
            if tag in stop:
                return

    def _open(self, parent: int, name: str, rest: str) -> int:
        if (known := _steps.get((name, rest))) is None:
            attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(rest)} if "=" in rest else {}
            classes = ".".join(sorted(re.sub(r"\d+", "#", attrs.get("class", "")).split()))
            mark = 2 if name in LEFT_OUT else _around(attrs) if attrs and name not in ("html", "body") else 0
            known = _remember(_steps, (name, rest), (f"{name}.{classes}" if classes else name, mark))
        step, mark = known
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(parent)
        self.mark.append(mark)
        above = self.path[parent]
        if (path := _paths.get((above, step))) is None:
            # a digest of the parent's path and this step: deep pages keep short paths
            path = _remember(_paths, (above, step), hashlib.blake2b(f"{above}>{step}".encode(), digest_size=8).hexdigest() + " " + step[:80])
        self.path.append(path)
        self.score.append(0.0)
        self.first.append(len(self.events))
        self.last.append(len(self.events))
        return node

    def _text(self, node: int, text: str) -> None:
        self.events.append((node, html.unescape(text) if "&" in text else text))

    def _rate(self) -> None:
        """Paragraph text counts for the container that holds it and half for the next one up; links count against it."""
        n = len(self.tag)
        linked, up, hard = [False] * n, [0] * n, [False] * n
        if 3 in self.mark:
            self._weigh_names()
        for i in range(1, n):
            p = self.parent[i]
            linked[i] = linked[p] or self.tag[i] == "a"
            up[i] = i if self.tag[i] in CONTAINER else up[p]
            hard[i] = hard[p] or self.mark[i] == 2
        own, links = [0] * n, [0] * n
        for node, text in self.events:
            if text is not None and not hard[node]:
                size = len(text) - text.count(" ")
                if linked[node]:
                    links[node] += size
                else:
                    own[node] += size
        whole, _ = self._under(own, links, hard)
        # a weak name marks its element, unless that holds most of the page
        self.out = list(hard)
        for i in range(1, n):
            self.out[i] = hard[i] or self.out[self.parent[i]] or (self.mark[i] == 1 and 2 * whole[i] <= whole[0])
        for i in range(n):
            size = own[i] - links[i]
            if not self.out[i] and size:
                c = up[i]
                self.score[c] += size
                if c and (g := up[self.parent[c]]):
                    self.score[g] += size / 2
        self.whole, self.links = self._under(own, links, self.out)

    def _weigh_names(self) -> None:
        """Elements named as links or controls are what they are called, unless they hold none within an article."""
        n = len(self.tag)
        controls, within = [t in CONTROLS for t in self.tag], [False] * n
        for i in range(n - 1, 0, -1):
            controls[self.parent[i]] = controls[self.parent[i]] or controls[i]
        for i in range(1, n):
            within[i] = within[self.parent[i]] or self.tag[self.parent[i]] in ("article", "main")
            if self.mark[i] == 3:
                self.mark[i] = 2 if controls[i] or not within[i] else 0

    def _under(self, own: list[int], links: list[int], out: list[bool]) -> tuple[list[int], list[int]]:
        """Characters of running text and of links in each element with all that it holds."""
        a, b = [0 if o else x for x, o in zip(own, out)], [0 if o else x for x, o in zip(links, out)]
        for i in range(len(a) - 1, 0, -1):
            a[self.parent[i]] += a[i]
            b[self.parent[i]] += b[i]
        return a, b

    def best(self) -> int:
        """The container of the highest score (the first of equals; the root if there is none), or what holds the rest of its article."""
        found, score = 0, 0.0
        mains = [i for i in range(1, len(self.tag)) if self.tag[i] == "main" and not self.out[i] and self.whole[i] > self.links[i]]
        low, high = (self.first[mains[0]], self.last[mains[0]]) if len(mains) == 1 else (0, self.last[0])
        for i in range(1, len(self.tag)):
            if self.score[i] > score and not self.out[i] and self.tag[i] in CONTAINER and low <= self.first[i] and self.last[i] <= high:
                found, score = i, self.score[i]
        if not found:
            return 0
        at, above = found, []
        while at > 0:
            above.append(at)
            at = self.parent[at]
        within = max((k for k, x in enumerate(above) if self.tag[x] == "article"), default=0)
        articles = [i for i in range(1, len(self.tag)) if self.tag[i] == "article" and not self.out[i]] if within or "article" in self.tag else []
        found = above[within]
        for x in above[within + 1 :]:
            if self.tag[x] in ("body", "html"):
                break
            text, links = self.whole[x] - self.whole[found], self.links[x] - self.links[found]
            other = any(self.first[x] <= self.first[i] and self.last[i] <= self.last[x] and not (self.first[found] <= self.first[i] and self.last[i] <= self.last[found]) for i in articles)
            if links > text or other:
                break
            if self.tag[x] in CONTAINER:
                found = x
        return found

    def at(self, path: str) -> list[int]:
        """The outermost containers of this path, in page order."""
        out, until = [], -1
        for i in range(1, len(self.tag)):
            if self.path[i] == path and not self.out[i] and self.first[i] >= until:
                out.append(i)
                until = self.last[i]
        return out

    def text(self, nodes: list[int]) -> str:
        blocks, now = [], []
        for node in nodes:
            for at, piece in self.events[self.first[node] : self.last[node]]:
                if piece is None:
                    blocks.append("".join(now))
                    now = []
                elif not self.out[at]:
                    now.append(piece)
            blocks.append("".join(now))
            now = []
        return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


    def agreed(self, path: str | None) -> str:
        """The text of the host's path, or of the page's own choice where that path doesn't hold enough of it."""
        k = self.best()
        own = self.text([k])
        nodes = self.at(path) if path else []
        if not nodes or nodes == [k]:
            return own
        text = self.text(nodes)
        within = k == 0 or any(self.first[k] <= self.first[i] and self.last[i] <= self.last[k] for i in nodes)
        return text if text and len(text) >= (NEARLY_ALL if within else LEAST_SHARE) * len(own) else own


def votes(pages: DataFrame) -> DataFrame:
    """host, path, score: each page's best container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], list[float]] = {}  # of this batch: copies fall together here
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html")):
                page = Page(source.as_py() or "")
                if k := page.best():
                    t = tally.setdefault((host_of(url), page.path[k]), [0, 0.0])
                    t[0] += 1
                    t[1] += page.score[k]
            yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in tally], pa.string()), "path": pa.array([p for _, p in tally], pa.string()), "pages": pa.array([int(t[0]) for t in tally.values()], pa.int64()), "score": pa.array([t[1] for t in tally.values()], pa.float64())})

    return pages.select("url", "html").mapInArrow(run, "host string, path string, pages long, score double")


def winners(voted: DataFrame) -> DataFrame:
    """host, path: the path with most pages, then the highest score, then the first by name."""
    by = voted.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.round(F.sum("score"), 3).alias("score"))
    best = F.min(F.struct((-F.col("pages")).alias("p"), (-F.col("score")).alias("s"), "path"))
    return by.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    won = common.written(winners(votes(pages)))
    few = won.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, path in zip(batch.column("html"), batch.column("path").to_pylist()):
                page = Page(source.as_py() or "")
                texts.append(page.agreed(path))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    plain = F.lower(F.coalesce("url", F.lit("")))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("host", F.when(F.coalesce(F.col("url").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//"), F.lit(False)), host).otherwise(plain))
    if few:
        rows = rows.join(F.broadcast(won), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS))
        rows = rows.withColumn("salt", salt).join(won.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))


QUERIES = {"op3_html": op3_html}
ORACLES: dict[str, str] = {}
