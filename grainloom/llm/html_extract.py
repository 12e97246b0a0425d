"""Main text of web pages by a site style tree: what a host repeats on its pages is not an article."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Fixed values of HTML: elements without content, whose content is no markup, that part blocks of text, that end a paragraph's
# or an item's reach.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article aside blockquote body details div fieldset figure footer form header html main nav section table td th ul ol dl".split())
# Elements that hold no text of an article, wherever they are; elements and words of a class, id or role that mark a branch as
# something else than an article; words that may stand beside those in one label.
NEVER = frozenset("head script style noscript template svg math canvas iframe object audio video map select button textarea datalist form dialog".split())
MARKED = frozenset("nav aside footer header menu".split())
MARKED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary widget widgets"
    " footer header masthead topbar contentinfo cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe signup login form search share sharing social related"
    " recommended pagination pager copyright skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
BESIDE = frozenset("site page main primary secondary global top bottom left right inner outer box block list item items area bar wrap wrapper container section content link links button buttons icon icons group row col column the to of form thread post".split())
MAIN = frozenset("main maincontent main-content content-main".split())
# What a new element may close: itself, its kin and an open paragraph.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDED = CONTAINER | {"p", *CLOSES}
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
LABEL = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
BREAK = None


#: Levels of branches that are told apart; what lies deeper belongs to the branch above it.
LEVELS = 64
#: Pages of a host whose so many longest texts are the same count once.
SIGNED = 3
#: Marks of a branch: a container, inside an article or main element, marked as something else, an article or main element, a body.
IS_CONTAINER, IS_INSIDE, IS_MARKED, IS_HOME, IS_BODY = 1, 2, 4, 8, 16


class Page:
    """Elements of a page as lists (tag, parent, labels), and its text as (element, text or BREAK).

    Containers and labelled elements are branches; branch[i] is the branch that element i is or lies in, and key[i] the
    hash of the branch's path.
    """

    def __init__(self, source: str | None):
        self.tag, self.parent, self.labels, self.hidden = ["#root"], [-1], [frozenset()], [False]
        self.branch, self.key, self.depth, self.flags, self.above = [0], [0], [0], [0], [-1]
        self.text: list[tuple[int, str | None]] = []
        source = source or ""
        at, stack, marks, opened = 0, [0], [], Counter()
        self._stack, self._marks, self._opened = stack, marks, opened
        while at < len(source):
            m = TOKEN.search(source, at)
            end = m.start() if m else len(source)
            if end > at:
                self.text.append((stack[-1], source[at:end]))
            if not m:
                break
            at = m.end()
            if m[1] or m[4]:
                tag, attributes = (m[1] or m[4]).lower(), m[2] if m[1] else m[5]
                self._close_implied(tag)
                node = self._add(tag, attributes, stack[-1])
                if tag in BLOCK:
                    self.text.append((node, BREAK))
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                    if tag in ("textarea", "title"):
                        self.text.append((node, source[at : close.start() if close else len(source)]))
                    at = close.end() if close else len(source)
                elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
                    if tag in ENDED:
                        marks.append(len(stack))
                    stack.append(node)
                    opened[tag] += 1
            elif m[3] and opened[m[3].lower()]:
                tag = m[3].lower()
                i = next(i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] == tag)
                if tag in BLOCK:
                    self.text.append((stack[i], BREAK))
                self._close(i)

    def _close(self, i: int) -> None:
        """Closes the i-th open element and all above it."""
        for node in self._stack[i:]:
            self._opened[self.tag[node]] -= 1
        del self._stack[i:]
        while self._marks and self._marks[-1] >= i:
            self._marks.pop()

    def _close_implied(self, tag: str) -> None:
        ends = CLOSES.get(tag, ())
        if tag in BLOCK and tag != "br":
            ends += ("p",)
        lowest = None
        for i in reversed(self._marks if ends else ()):  # a few at most: an open item ends the one before it
            name = self.tag[self._stack[i]]
            if name in ends:
                lowest = i
            elif name in CONTAINER:
                break
        if lowest is not None:
            self.text.append((self._stack[lowest], BREAK))
            self._close(lowest)

    def _add(self, tag: str, attributes: str, parent: int) -> int:
        labels: set[str] = set()
        hidden = False
        if attributes.strip():
            for name, a, b, c in LABEL.findall(attributes):
                if name.lower() in ("hidden", "aria-hidden"):
                    hidden |= name.lower() == "hidden" or "true" in (a, b, c)
                else:
                    labels |= {re.sub(r"([a-z])([A-Z])", r"\1-\2", x).lower() for x in (a or b or c).split()}
        i = len(self.tag)
        up = self.branch[parent]
        self.tag.append(tag)
        self.parent.append(parent)
        self.labels.append(frozenset(labels))
        self.hidden.append(hidden)
        inside = self.flags[up] & (IS_INSIDE | IS_HOME) > 0
        home = tag in ("article", "main") or tag != "body" and bool(labels & MAIN)
        marked = tag in MARKED and not (tag == "header" and inside) or tag not in ("html", "body", "main", "article", "h1") and any(map(_marks, labels))
        if (tag in CONTAINER or labels or marked) and self.depth[up] < LEVELS:
            self.branch.append(i)
            words = sorted(re.sub(r"[^a-z]+", " ", x).strip() for x in labels)
            self.key.append(xxhash.xxh64_intdigest(f"{self.key[up]} {tag} {words}"))
            self.depth.append(self.depth[up] + 1)
            self.above.append(up)
            self.flags.append(IS_CONTAINER * (tag in CONTAINER) | IS_INSIDE * inside | IS_MARKED * marked | IS_HOME * home | IS_BODY * (tag in ("html", "body")))
        else:
            self.branch.append(up)
            for own in (self.key, self.depth, self.above, self.flags):
                own.append(own[up])
        return i

    def within(self, wanted: list[bool]) -> list[bool]:
        """Whether each element or one above it is wanted; parents come before children."""
        out: list[bool] = []
        for w, p in zip(wanted, self.parent):
            out.append(w or (p >= 0 and out[p]))
        return out

    def never(self) -> list[bool]:
        """Elements that hold no text of an article: by their kind (a form, if it has no article or heading), hidden, or
        readers' comments."""
        wraps = [t in ("article", "main", "h1") for t in self.tag]
        for i in range(len(self.tag) - 1, 0, -1):
            wraps[self.parent[i]] |= wraps[i]
        comment = lambda labels: any(_marks(x, COMMENT_WORDS) for x in labels)
        return [h or t in NEVER and not (w and t == "form") or t not in ("html", "body") and comment(x) for h, t, x, w in zip(self.hidden, self.tag, self.labels, wraps)]

    def blocks(self, keep: list[bool]) -> list[str]:
        out, now = [], []
        for node, text in [*self.text, (0, BREAK)]:
            if text is BREAK:
                if now:
                    block = " ".join(entities.unescape("".join(now)).split())
                    if block:
                        out.append(block)
                    now = []
            elif keep[node]:
                now.append(text)
        return out

    def signature(self) -> int:
        """Hash of the page's longest texts, which pages of one article share, whatever stands around them."""
        gone = self.within(self.never())
        texts = {" ".join(t.split()) for node, t in self.text if t is not BREAK and not gone[node]}
        longest = sorted(((x.count(" "), x) for x in texts if x), reverse=True)[:SIGNED]
        return xxhash.xxh64_intdigest("\n".join(x for _, x in longest))

    def tree(self) -> Iterator[tuple[int, int, int, int]]:
        """(kind, branch key, value, number) rows of this page's part of the style tree, each once.

        SELF: a branch and its marks; ABOVE: a branch and one above it, 1 for the next one; STYLE: the sequence of a branch's
        child elements, runs counting once; CONTENT: a text that lies directly in a branch, and its words.
        """
        gone = self.within(self.never())
        children: dict[int, list[str]] = {}
        for i in range(1, len(self.tag)):
            if gone[i]:
                continue
            seq = children.setdefault(self.key[self.branch[self.parent[i]]], [])
            if not seq or seq[-1] != self.tag[i]:
                seq.append(self.tag[i])
        seen: set[int] = set()
        for i in range(1, len(self.tag)):
            if self.branch[i] == i and not gone[i] and self.key[i] not in seen:
                seen.add(self.key[i])
                yield SELF, self.key[i], 0, self.flags[i]
                yield STYLE, self.key[i], xxhash.xxh64_intdigest(" ".join(children.get(self.key[i], ()))), 0
                up, step = self.above[i], 1
                while up > 0:
                    yield ABOVE, self.key[i], self.key[up], step
                    up, step = self.above[up], 0
        told: set[tuple[int, int]] = set()
        for node, text in self.text:
            if text is not BREAK and not gone[node] and (words := text.split()):
                row = self.key[node], xxhash.xxh64_intdigest(" ".join(words))
                if row not in told:
                    told.add(row)
                    yield CONTENT, *row, len(words)

    def main_text(self, low: dict[int, bool]) -> str:
        """The text without branches of low importance; low: of the branches that the host's tree judges. Others go by their marks.

        If the host has no tree, and the page an article (else main) element, only that is read.
        """
        noise = self.never()
        for i, k in enumerate(self.key):
            if self.branch[i] == i and i:
                noise[i] = noise[i] or (low[k] if k in low else bool(self.flags[i] & IS_MARKED))
        gone = self.within(noise)
        region = None
        for tags in ({"article"}, {"main"}) if not low else ():
            home = [t in tags or "main" in tags and t != "body" and bool(x & MAIN) for t, x in zip(self.tag, self.labels)]
            if any(h and not g for h, g in zip(home, gone)):
                region = self.within(home)
                break
        return "\n".join(self.blocks([not g and (region is None or r) for g, r in zip(gone, region or gone)]))


def _marks(label: str, words: frozenset[str] = MARKED_WORDS) -> bool:
    """Whether a label consists of such words, and words that may stand beside them: share-buttons, but not share-price."""
    parts = [x for x in re.split(r"[^a-z]+", label) if x]
    return any(x in words for x in parts) and all(x in MARKED_WORDS or x in COMMENT_WORDS or x in BESIDE for x in parts)


SELF, ABOVE, STYLE, CONTENT = range(4)
#: What styles, against contents, count for a branch with one style more.
GAMMA = 0.9
#: A branch whose importance is low goes if the texts that vary beside it weigh this share of what it says: where nothing
#: varies, what is repeated is the article.
VARIED_SHARE = 0.25
#: A marked branch goes if what it says is less than this share of what its largest neighbour says.
MARKED_SHARE = 0.5


def tree_rows(pages: DataFrame, host: str, html_col: str) -> DataFrame:
    """(host, kind, key, value, pages, number): the style tree of each host, merged over its pages; pages of one article (see
    Page.signature) count once. host: a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            found: dict[tuple, int] = {}
            for h, p in zip(b.column(0).to_pylist(), b.column(1)):
                page = Page(p.as_py())
                name = page.signature()
                found.update(((h, kind, key, value, name), number) for kind, key, value, number in page.tree())
            cols = list(zip(*found)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            rows = [pa.array([signed(x) for x in c] if n > 1 else c, k) for n, (c, k) in enumerate(zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(found.values(), pa.int64())], names=["host", "kind", "key", "value", "page", "number"])

    rows = pages.where(F.col(host).isNotNull()).select(F.xxhash64(host), F.col(html_col).cast("string")).mapInArrow(run, "host long, kind int, key long, value long, page long, number long")
    branch = ["host", "kind", "key", "value"]
    return rows.groupBy(*branch, "page").agg(F.max("number").alias("number")).groupBy(*branch).agg(F.count(F.lit(1)).alias("pages"), F.max("number").alias("number"))


def judged_branches(tree: DataFrame, threshold: float, share: float, min_pages: int) -> DataFrame:
    """(host, key, low) of the branches on min_pages pages of a host or more.

    Over the m pages with a branch, the entropy of its styles, divided by ln m, is the importance P of its presentation. A
    text that lies on c of them has the weight of its words times 1 - ln c / ln m; a branch weighs what the texts in it do,
    and its weight for each word is the importance C of its content. With n styles its importance is
    (1 - 0.9^n) P + 0.9^n C. Low are branches
    - of an importance below the threshold, if the largest container or the texts beside them weigh a quarter of what they
      say (inside an article: marked ones only, as authors repeat themselves and a host's articles may be alike);
    - that are containers outside articles and weigh less than `share` of the largest container beside them, if that
      weighs more than the texts between them and a quarter of what they say: what varies from page to page but says little;
    - that are marked and weigh less than half of the largest container or of the texts beside them.
    """
    key = ["host", "key"]
    nodes = tree.where(F.col("kind") == SELF).select(*key, F.col("pages").alias("m"), F.col("number").alias("flags"))
    log = F.greatest(F.ln("m"), F.lit(1e-9))
    texts = tree.where(F.col("kind") == CONTENT).groupBy(*key).agg(F.sum(F.col("pages") * F.col("number")).alias("said"), F.sum(F.col("pages") * F.col("number") * F.ln("pages")).alias("again"))
    texts = nodes.join(texts, key).select(*key, "said", F.greatest(F.col("said") - F.col("again") / log, F.lit(0.0)).alias("direct"))
    above = tree.where(F.col("kind") == ABOVE)
    up = texts.join(above.select(*key, F.col("value").alias("up")), key).select("host", F.col("up").alias("key"), "said", "direct")
    total = texts.unionByName(up).groupBy(*key).agg(F.sum("said").alias("said"), F.sum("direct").alias("weight"))
    styles = tree.where(F.col("kind") == STYLE).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pages") * F.ln("pages")).alias("s"))
    each = nodes.join(total, key, "left").join(styles, key).join(texts.select(*key, "direct"), key, "left").na.fill(0, ["said", "weight", "direct"])
    style, content = (F.ln("m") - F.col("s") / F.col("m")) / log, F.coalesce(F.try_divide("weight", "said"), F.lit(0.0))
    part = F.pow(F.lit(GAMMA), F.col("n"))
    each = each.withColumn("importance", (1 - part) * style + part * content)
    is_ = lambda flag: F.col("flags").bitwiseAND(F.lit(flag)) != 0
    parents = each.join(above.where("number = 1").select(*key, F.col("value").alias("parent")), key)
    largest = parents.where(is_(IS_CONTAINER)).groupBy("host", "parent").agg(F.max("weight").alias("largest"))
    beside = largest.join(each.select("host", F.col("key").alias("parent"), F.col("direct").alias("between")), ["host", "parent"])
    placed = parents.where(F.col("m") >= min_pages).join(beside, ["host", "parent"], "left").na.fill(0, ["largest", "between"])
    varied = F.greatest("largest", "between") >= VARIED_SHARE * F.col("said")
    again = (F.col("importance") < threshold) & varied & (~is_(IS_INSIDE) | is_(IS_MARKED))
    little = is_(IS_CONTAINER) & ~is_(IS_INSIDE) & varied & (F.col("weight") < share * F.col("largest")) & (F.col("largest") > F.col("between"))
    other = is_(IS_MARKED) & (F.col("weight") < MARKED_SHARE * F.greatest("largest", "between"))
    return placed.select(*key, ((again | little | other) & ~is_(IS_HOME) & ~is_(IS_BODY)).alias("low"))


#: Judged branches up to so many are broadcast (17 bytes each); more are joined by host and salt.
BROADCAST_BRANCHES = 100_000
SALTS = 16


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.3, share: float = 0.1, min_pages: int = 5) -> DataFrame:
    """The article of every page: id_col, url_col, text string, n_chars long.

    The pages of a host (that of the URL, lower-cased) are merged into a style tree, in which pages whose three longest
    texts are the same count once; branches of low importance go from each page (see judged_branches), whatever they are
    called; inside an article only marked ones. Branches over 64 deep are judged with the one above them. Scripts, styles, forms, hidden elements and readers'
    comments always go. Only branches on fewer than min_pages pages go by what HTML or their class, id or role marks
    them as; and of a page whose host has no such tree, only the article (else main) element is read if it has one.
    Whole texts are read, in time linear in the page; unclosed elements end where HTML says; a tag with an unclosed quote or
    cut off ends at the next > or the end; character references are decoded; white space within a block becomes one
    space; blocks are joined by line feeds. Null and empty pages give an empty text; a null URL or one without a host is
    judged by its own markup alone; repeated rows and equal ids keep their rows and their text; further columns are ignored.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.lower(F.nullif(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    hosted = pages.withColumn("host", host)
    scratch = Scratch(pages.sparkSession)
    judged = scratch.keep(judged_branches(scratch.keep(tree_rows(hosted, "host", "html")), threshold, share, min_pages))
    scratch.only(judged)
    hosted = hosted.withColumn("host", F.when(F.col("host").isNotNull(), F.xxhash64("host")))
    schema = f"id {pages.schema['id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string"

    def texts(b: pa.RecordBatch, trees) -> pa.RecordBatch:
        found = [Page(p.as_py()).main_text(t) for p, t in zip(b.column(2), trees)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=["id", "url", "text"])

    if judged.count() <= BROADCAST_BRANCHES:
        by_host: dict[int, dict[int, bool]] = {}
        for r in judged.collect():
            by_host.setdefault(r["host"], {})[r["key"] & (1 << 64) - 1] = r["low"]
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield texts(b, [shared.value.get(h, {}) for h in b.column(3).to_pylist()])

        out = hosted.select("id", "url", "html", "host").mapInArrow(run, schema)
    else:
        lists = judged.groupBy("host").agg(F.collect_list(F.struct("key", "low")).alias("tree")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.lit(SALTS)).cast("int")).join(lists, ["host", "salt"], "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield texts(b, [{r["key"] & (1 << 64) - 1: r["low"] for r in t or ()} for t in b.column(3).to_pylist()])

        out = joined.select("id", "url", "html", "tree").mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
