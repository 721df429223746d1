"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is cut into words and tags in order, in one pass, and a stack of open elements says where each word stands. Words
score positive by their block, tags negative, words in noise more so; a linear scan finds the contiguous region with the
largest sum. Its text is that of its words but those in noise.

Weights are log odds, learned from labelled pages: those that mark their content with an article or main element. There an
element in or around the content speaks for its class names (or its tag, if it has none), and the outermost element of all that lies
beside the content against them. Words that commonly name menus, adverts, comments and so on are noise from the start. Pages to
be extracted need no content element; if they have one, words outside it score negative.

By name only elements go whose text is never prose: scripts, styles, forms, options and their kin, and what is hidden.
Blocks of the region are joined by a line feed, white space within a block becomes one space.

Null, empty and tagless pages are defined: empty text for the first two, the whole text for the last. Unclosed
elements end with their parent, stray end tags count for nothing, and a tag that never ends takes the rest of the page, as in browsers.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsleuth.llm.common import by_hash, slices, utf8

#: Labelled pages that the weights are learned from, about; chosen by a hash of their ids.
LABELLED_PAGES = 2000
#: An element of at most this weight is noise.
NOISE = -1.0
#: Words outside a page's content element; what all of a noise element costs at most, so that it seldom splits the text around it.
OUTSIDE, NOISE_COST = -3.0, 10.0
#: The least that a tag costs.
TAG = -0.05

# Elements by their kind, and words that name what isn't content.
RAW = set("script style noscript template textarea title iframe svg math object canvas audio video head".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split())
CELL = {"td", "th", "br", "wbr"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = {"form", "select", "datalist", "fieldset", "dialog", "progress", "meter"}
NOISE_TAGS = {"nav", "footer", "aside", "menu"}
CONTAINERS = set("address article aside body center details dir div dl fieldset figure footer header menu nav ol section table tbody tr ul".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
ADVERT_WORDS = set("ad ads advert adverts advertisement advertising adv sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr".split())
NOISE_WORDS = ADVERT_WORDS | set("banner sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead notice notices alert popup modal overlay newsletter subscribe signup login comment comments commentlist disqus replies respond reply share sharing social related recommended widget widgets toolbar pagination pager search skip disclaimer".split())
NEUTRAL_WORDS = set("item items list box block area bar container wrapper wrap inner outer left right top bottom panel links link posts thread site global main primary secondary the and row col column group".split())
CONTENT_WORDS = set("content article articles post entry story main body text prose".split())
CONTENT_TAGS = {"article", "main"}
#: What an opening tag ends, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(>|\Z)|[^<]+|<", re.DOTALL)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?\s*([a-z]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_NAMES = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", words, ""), ("open", tag, attributes) and ("close", tag, ""), in order and in time linear in the page."""
    at, n = 0, len(page)
    endless: set[str] = set()
    while at < n and (m := _TOKEN.match(page, at)):
        at = m.end()
        closing, tag, attrs, end = m.groups()
        if tag is None:
            if not m.group().startswith(("<!", "<?", "</")):
                yield "text", m.group(), ""
            continue
        if not end:  # cut off by the end of the page
            return
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                close = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                if close:
                    stop = page.find(">", close.end())
                    at = stop + 1 if stop >= 0 else n
                elif tag == "head":  # its content is left to its own tags
                    endless.add(tag)
                else:
                    at = n
            continue
        if closing:
            yield "close", tag, ""
        else:
            yield "open", tag, attrs
            if attrs.endswith("/") and tag not in VOID and tag not in BLOCK:
                yield "close", tag, ""


class Element:
    """An open element: its names, whether it lies in a content element, is never content, or belongs to noise."""

    __slots__ = ("block", "content", "count", "features", "link", "low", "never", "noise", "parent", "place", "spent", "tag", "wraps")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.content = self.never = self.place = False
        self.features: tuple[str, ...] = ()
        self.block, self.low, self.noise, self.spent = "-", 0.0, None, 0.0
        self.count, self.wraps = 0, False
        self.link = tag == "a" or parent is not None and parent.link and tag not in BLOCK


def names_of(attrs: str) -> list[tuple[str, str]]:
    """(kind, name) of an element's classes and id, in lower case."""
    if "=" not in attrs:
        return []
    return [(k.lower(), x) for k, a, b, c in _NAMES.findall(attrs) for x in (a or b or c).lower().split()]


def named_noise(name: str) -> set[str]:
    """The noise words of a name all of whose parts are noise words or tell nothing."""
    parts = [x for x in re.split(r"[-_]+|\d+", name) if x]
    hit = NOISE_WORDS.intersection(parts)
    return hit if hit and all(x in NOISE_WORDS or x in NEUTRAL_WORDS for x in parts) else set()


def prior(tag: str, attrs: str, names: list[tuple[str, str]], inside: bool, placed: bool) -> float:
    """The weight of an element that labelled pages say nothing about. placed: in an element named like content."""
    if tag in NOISE_TAGS or tag == "header" and not inside and not placed:
        return -3.0
    if (m := _ROLE.search(attrs)) and m[1].lower() in NOISE_ROLES:
        return -3.0
    for kind, name in names:
        if (hit := named_noise(name)) and (tag in CONTAINERS and (kind == "class" or not inside or name in NOISE_WORDS) or hit & ADVERT_WORDS):
            return -3.0
    return 0.0


def walk(page: str, weights: dict[str, float], memo: dict) -> Iterator[tuple[str, str, Element]]:
    """("text", words, innermost element), ("tag", name, element) where a block starts or ends, ("cell", "", element) for white space by markup.

    Text that is never content is left out.
    """
    root = Element("", None)
    top, opened = root, Counter()
    lower = None

    def unclosed(tag: str) -> bool:
        nonlocal lower
        lower = page.lower() if lower is None else lower
        return lower.count(f"<{tag}") > lower.count(f"</{tag}")

    def pop() -> Iterator[tuple[str, str, Element]]:
        nonlocal top
        gone, top = top, top.parent
        opened[gone.tag] -= 1
        if gone.tag in BLOCK and not gone.never:
            yield "tag", gone.tag, gone

    for kind, tag, attrs in tokens(page):
        if kind == "text":
            if not top.never:
                yield "text", tag, top
            continue
        if kind == "close":
            if opened[tag] > 0:
                while top.tag != tag:
                    yield from pop()
                yield from pop()
            continue
        if tag in CONTENT_TAGS and any(opened[t] > 0 for t in ("nav", "footer", "aside", "header", "menu", "form")):
            # content doesn't lie in an element that is noise for want of an end tag
            broken = [t for t in ("nav", "footer", "aside", "header", "menu", "form") if opened[t] > 0 and unclosed(t)]
            while any(opened[t] > 0 for t in broken):
                yield from pop()
        if tag in BLOCK and opened["p"] > 0:
            inner = top
            while inner.tag != "p" and inner.tag not in BLOCK:
                inner = inner.parent
            if inner.tag == "p":
                while top is not inner:
                    yield from pop()
                yield from pop()
        if tag in ENDS and any(opened[t] > 0 for t in ENDS[tag][0]):
            ended, bounds = ENDS[tag]
            inner = top
            while inner.tag not in ended and inner.tag not in bounds and inner is not root:
                inner = inner.parent
            if inner.tag in ended:
                while top is not inner:
                    yield from pop()
                yield from pop()
        if tag in VOID:
            if tag in CELL and not top.never:
                yield "cell", "", top
            elif tag == "hr" and not top.never:
                yield "tag", "hr", top
            continue
        e = Element(tag, top)
        e.place = top.place
        key = (tag, attrs, top.content, top.place)
        if (known := memo.get(key)) is None:
            names = names_of(attrs)
            own = tuple(f".{x}" for _, x in names) or ((tag,) if tag not in ("div", "section", "span", "body", "html") else ())
            low = min([prior(tag, attrs, names, top.content, top.place), *(weights[f] for f in own if f in weights)])
            main = tag in CONTENT_TAGS or (m := _ROLE.search(attrs)) is not None and m[1].lower() == "main"
            placed = main or any(CONTENT_WORDS.intersection(re.split(r"[-_]+", x)) and not named_noise(x) for _, x in names)
            never = tag in NEVER or bool(_HIDDEN.search(attrs))
            if len(memo) > 50_000:
                memo.clear()
            known = memo[key] = (own, low, main, placed, never)
        e.features, low, main, placed, e.never = known
        e.place = top.place or placed
        e.content = top.content or main and low > NOISE and top.low > NOISE
        e.never = e.never or top.never
        e.low, e.noise = top.low, top.noise
        if low <= NOISE and top.low > NOISE:
            e.low, e.noise = low, e
        e.block = tag if tag in BLOCK else top.block
        top = e
        opened[tag] += 1
        if tag in BLOCK and not e.never:
            yield "tag", tag, e
        elif tag in CELL and not e.never:
            yield "cell", "", e


def count(page: str) -> Counter:
    """(feature, in the content element), words or tags, of a labelled page.

    "e": of elements in and around the content, and of the outermost ones beside it; "w", "l": words by block, in links; "t": tags of the same elements.
    """
    out: Counter = Counter()
    beside: list[Element] = []
    seen: set[int] = set()
    for kind, value, e in walk(page, {}, {}):
        inside, n = e.content, len(value.split())
        if kind == "text" and not (inside and e.noise):
            out[f"w {e.block}", inside] += n
            if e.link:
                out["l", inside] += n
            while e.tag:
                if inside:
                    e.wraps = not e.content or e.wraps
                    for f in e.features if e.tag not in CONTENT_TAGS else ():
                        out[f"e {f}", True] += n
                else:
                    if id(e) not in seen:
                        seen.add(id(e))
                        beside.append(e)  # kept, so that no other object gets its id
                    e.count += n
                e = e.parent
        elif kind == "tag" and inside and not e.noise and e.tag not in CONTENT_TAGS:
            out[f"t {value}", True] += 1
    for e in beside:
        if e.count and not e.wraps and (not e.parent.tag or e.parent.wraps):
            for f in e.features:
                out[f"e {f}", False] += e.count
            out[f"t {e.tag}", False] += 2
    return out


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of content: of element names between -3 and 3, of words by block between 0.5 and 3, of links between -1 and 3; costs of tags between -0.5 and -0.05."""
    out: dict[str, float] = {}
    clamp = lambda x, a, b: max(a, min(b, x))
    for name in {k for k, _ in counts}:
        a, b = counts.get((name, True), 0), counts.get((name, False), 0)
        odds = math.log((a + 1) / (b + 1))
        kind, _, what = name.partition(" ")
        if kind == "e":
            out[what] = clamp(odds, -3.0, 3.0)
        elif kind == "w":
            out[name] = clamp(odds, 0.5, 3.0)
        elif kind == "l":
            out[name] = clamp(odds if a else -1.0, -1.0, 3.0)
        else:
            out[name] = clamp(odds, -0.5, TAG)
    return out


#: Without labelled pages: words 1, tags TAG, words in links -1.
DEFAULT: dict[str, float] = {}


def scored_events(page: str, w: dict[str, float], memo: dict) -> list[tuple[float, str, str, bool]]:
    """Score, kind, text and whether it is noise, of each word run and tag."""
    found = []
    marked = None
    for kind, value, e in walk(page, w, memo):
        if kind == "text":
            n = len(value.split())
            if e.noise is not None:
                # amid what is named content it costs no more than a tag
                cost = min(3.0 * n, (-TAG if e.noise.parent.place else NOISE_COST) - e.noise.spent)
                e.noise.spent += cost
                found.append((-cost, kind, value, True, e.content))
            else:
                each = w.get(f"w {e.block}", 1.0)
                found.append((n * (min(each, w.get("l", -1.0)) if not e.content and e.link else each), kind, value, False, e.content))
            marked = marked or e.content
        elif kind == "tag":
            # noise's tags cost nothing beside its words, and amid what is named content tags hardly do, so no short block is lost
            cost = 0.0 if e.noise else TAG if e.place else w.get(f"t {value}", TAG)
            found.append((cost, kind, value, e.noise is not None, e.content))
        else:
            found.append((0.0, kind, " ", e.noise is not None, e.content))
    if marked:  # the page says where its content is
        return [(s if inside or kind != "text" else OUTSIDE * len(v.split()), kind, v, noise) for s, kind, v, noise, inside in found]
    return [x[:4] for x in found]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and stop of the contiguous part with the largest sum, the first and shortest such; (0, 0) if none is positive."""
    best, start, stop, total, first = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, start, stop = total, first, i + 1
    return start, stop


def joined(found: list[tuple[float, str, str, bool]]) -> str:
    blocks, own = [], []
    for _, kind, value, noise in found:
        if kind == "tag":
            blocks.append("".join(own))
            own = []
        elif not noise:
            own.append(value)
    blocks.append("".join(own))
    # references are decoded after cutting, so that an escaped "<" is never markup
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(page: str, w: dict[str, float], memo: dict | None = None) -> str:
    """The text of the best region."""
    found = scored_events(page, w, {} if memo is None else memo)
    start, stop = best_region([x[0] for x in found])
    return joined(found[start:stop])


def learned(df: DataFrame, id_col: str = "page_id", html_col: str = "html", pages: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from about so many labelled pages; the counts are summed by Spark, a row for each feature of those pages reaches the driver."""
    content = F.col(html_col).cast("string")
    labelled = df.where(content.rlike("(?i)<(article|main)[ >]"))
    sample = by_hash(labelled, id_col, pages).select(content.cast("binary").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches):
            for h in batch.column(0).to_pylist():
                total.update(count(h.decode("utf-8", "replace")))
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["k", "i", "n"])

    rows = sample.mapInArrow(run, "k string, i boolean, n bigint").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()
    return weights({(r["k"], r["i"]): r["n"] for r in rows})


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fitted: dict[str, float] | None = None) -> DataFrame:
    """id, url, text, n_chars: one row per input row, without a shuffle; weights are learned from df unless given."""
    own = learned(df, id_col, html_col) if fitted is None else fitted
    inner = df.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), utf8(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in slices(batches):
            texts = [extract(h.decode("utf-8", "replace"), own, memo) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["__id", "__url", "text", "n_chars"])

    kind = lambda c: inner.schema[c].dataType.simpleString()
    return inner.mapInArrow(run, f"__id {kind('__id')}, __url {kind('__url')}, text string, n_chars bigint").withColumnsRenamed({"__id": id_col, "__url": url_col})
