"""The main text of web pages: the contiguous region that scores best, by words for and tags against it."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

#: Labelled pages that weights are learnt from, at most, and characters of one of them.
TRAINING_PAGES, TRAINING_CHARS = 2000, 1 << 20
#: Characters of html that a task holds as results before they leave.
HELD_CHARS = 4 << 20

# Elements of HTML.
RAW = "script style title textarea noscript template iframe xmp noembed noframes".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
CLOSED_BY_BLOCKS = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose siblings don't close beyond them.
SCOPES = frozenset(["ul", "ol", "menu", "dl", "table", "body", "html", "article", "section", "div", "select"])
#: Elements that hold no main text wherever they stand.
ASIDE = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "form": "form", "select": "form", "button": "form", "dialog": "notice", "head": "markup", "search": "form", "object": "markup", "canvas": "markup", "audio": "markup", "video": "markup", "svg": "markup"}
#: Words in class, id or role that say what an element is.
KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs tablist sitemap skip skiplink toc hamburger dropdown",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer colophon contentinfo copyright bottombar",
    "sidebar": "sidebar aside rail widget widgets complementary related recommended recommendations recommendation trending popular teaser teasers promobox",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay disclaimer paywall toast announcement interstitial",
    "advert": "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted outbrain taboola dfp",
    "form": "form search searchbox searchform newsletter subscribe subscription signup signin login register contactform",
    "comments": "comment comments commentlist commenters replies reply respond discussion disqus guestbook",
    "social": "share sharing shares social follow addthis sharethis",
}
KIND_OF = {word: kind for kind, words in KINDS.items() for word in words.split()}
#: Words beside which a header is that of the text itself, and those in front of a word that deny it.
OF_CONTENT = frozenset("article post entry story content title".split())
DENIED = frozenset("has with no without is not".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(" + "|".join(RAW) + r")(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def kind(tag: str, attributes: str, inside_article: bool) -> str | None:
    """What an element is that holds no main text; None for all others."""
    found = ASIDE.get(tag) or ("header" if tag == "header" and not inside_article else None)
    if found or not attributes or tag in ("html", "body", "main"):
        return found
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if (name == "hidden" and value != "until-found") or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return "hidden"
        if name in ("class", "id", "role"):
            for group in value.split():
                words = [w.lower() for w in _PARTS.findall(group)]
                if words and words[0] in DENIED:
                    continue
                for word in words:
                    of = KIND_OF.get(word)
                    if of and not (of == "header" and OF_CONTENT.intersection(words)):
                        # An article's own class lists say what it is about, not what it is.
                        if tag != "article" or of in ("comments", "advert", "sidebar"):
                            found = found or of
    return found


class Page:
    """Blocks of text in page order, with what lies between them.

    ``texts`` are the blocks; ``contexts`` has the words of each by where they stand: block element, link or not, kind of other part
    around, and whether inside the page's only article (or only ``main``, or unknown where it has none or many).  ``between[i]`` are the
    tags met in front of block i; what is inside another part counts as one tag, so that long ones cost no more than short ones.
    """

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.contexts: list[Counter] = []
        self.between: list[list[str]] = []
        self.inside: list[bool | None] = []
        self.kinds: list[str | None] = []
        self.articles = self._mains = 0
        self._in_main: list[bool] = []
        self._in_article: list[bool] = []
        self._stack: list[tuple[str, str | None, bool]] = []  # element, kind of it or of what it is in, inside an article
        self._pieces: list[str] = []
        self._words: Counter = Counter()
        self._tags: list[str] = []
        self._link = 0
        at = 0
        for found in _TOKEN.finditer(source):
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            if found[4] and not found[3]:
                self._open(found[4].lower(), found[5])
            elif found[4]:
                self._close(found[4].lower())
        if at < len(source):
            self._text(source[at:])
        self._end_block()
        self.inside = self._in_article if self.articles == 1 else self._in_main if self._mains == 1 else [None] * len(self.texts)
        self.contexts = [Counter({(*place, inside): n for place, n in words.items()}) for words, inside in zip(self.contexts, self.inside, strict=True)]

    def _place(self) -> tuple[str, str | None, bool]:
        return self._stack[-1] if self._stack else ("body", None, False)

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._pieces.append(text)
        if not text.isspace():
            self._words[bool(self._link)] += max(len(text.split()), len(text) // 8)

    def _end_block(self) -> None:
        text = " ".join("".join(self._pieces).split()) if self._pieces else ""
        self._pieces = []
        if text:
            tag, of, inside = self._place()
            self.texts.append(text)
            self.contexts.append(Counter({(tag, link, of): n for link, n in self._words.items()}))
            self.between.append(self._tags)
            self._in_article.append(inside)
            self._in_main.append(any(name == "main" for name, *_ in self._stack))
            self.kinds.append(of)
            self._tags = []
        self._words = Counter()

    def _tag(self, name: str, of: str | None) -> None:
        self._tags.append(f"{name}:{of}" if of else name)

    def _pop(self, to: int) -> None:
        while len(self._stack) > to:
            name, of, _ = self._stack.pop()
            if not of or not self._place()[1]:
                self._tag("/" + name, of)

    def _open(self, name: str, attributes: str) -> None:
        if name not in BLOCKS:
            if name == "br":
                self._pieces.append(" ")
            elif name == "a":
                self._link = 1
            elif name not in VOID and not (name == "svg" and attributes.endswith("/")):
                _, around, inside = self._place()
                of = kind(name, attributes, inside)
                if of and not around:  # part of a block that is something else, such as a share button: a block of its own
                    self._end_block()
                    self._tag(name, of)
                if (of and not around) or (self._stack and self._stack[-1][0] == name):
                    self._stack.append((name, around or of, inside))
            return
        self._end_block()
        if name in SIBLINGS:
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i][0] in SIBLINGS[name]:
                    self._pop(i)
                    break
                if self._stack[i][0] in SCOPES:
                    break
        if self._stack and self._stack[-1][0] in CLOSED_BY_BLOCKS:
            self._pop(len(self._stack) - 1)
        _, of, inside = self._place()
        own = kind(name, attributes, inside)
        self.articles += name == "article" and not (of or own)
        self._mains += name == "main"
        self._link = 0
        if not of:
            self._tag(name, own)
        if name not in VOID:
            self._stack.append((name, of or own, inside or (name == "article" and not (of or own))))

    def _close(self, name: str) -> None:
        if name == "a":
            self._link = 0
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == name:
                self._end_block()
                self._pop(i)
                return
        if name == "p" or name in BLOCKS:
            self._end_block()


#: What is believed of parts of a page before any labelled page is seen, as words and tags in main text and elsewhere.
BEFORE = {
    "word": (30.0, 10.0), "link": (2.0, 20.0), "other": (0.1, 60.0), "outside": (0.5, 20.0),
    "tag": (10.0, 20.0), "text tag": (30.0, 10.0), "end of other": (10.0, 0.2), "insert": (1.0, 6.0), "frame": (0.1, 60.0),
}
#: Parts that also stand in the midst of main text; the rest stand around it.
INSERTS = frozenset("advert form social notice sidebar hidden markup".split())
#: Words or tags of labelled pages that count at most, so that a context met often doesn't outweigh all that was believed before.
EVIDENCE = 50.0
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption br li ul ol dl dt dd".split())
#: The most that a word gains, the least and the most that a tag costs.
MOST_GAIN, CHEAPEST, DEAREST = 2.0, 0.02, 6.0


class Weights:
    """Gains of words and costs of tags: how much oftener they stand in main text than elsewhere, or the other way round."""

    def __init__(self, counts: dict[tuple[str, str], tuple[int, int]]):
        self._counts = counts
        self._known: dict = {}

    def _seen(self, what: str, name: str) -> tuple[float, float]:
        inside, outside = self._counts.get((what, name), (0, 0))
        part = min(1.0, EVIDENCE / max(inside + outside, 1))
        return inside * part, outside * part

    def word(self, context: tuple[str, bool, str | None, bool | None]) -> float:
        """log(1 + odds) of a word at this place, within a bound."""
        if context not in self._known:
            _, link, of, within = context
            inside, outside = BEFORE["other" if of else "outside" if within is False else "link" if link else "word"]
            seen = self._seen("word", word_key(context))
            self._known[context] = min(MOST_GAIN, math.log1p((seen[0] + inside) / (seen[1] + outside)))
        return self._known[context]

    def tag(self, name: str) -> float:
        """log(1 + odds) against main text, within bounds."""
        if name not in self._known:
            tag, _, of = name.partition(":")
            inside, outside = BEFORE[("end of other" if tag[0] == "/" else "insert" if of in INSERTS else "frame") if of else "text tag" if tag.strip("/") in TEXT_TAGS else "tag"]
            seen = self._seen("tag", name) if not (of and tag[0] == "/") else (0.0, 0.0)
            self._known[name] = min(DEAREST, max(CHEAPEST, math.log1p((seen[1] + outside) / (seen[0] + inside))))
        return self._known[name]


def word_key(context: tuple[str, bool, str | None, bool | None]) -> str:
    tag, link, of, within = context
    return f"{of or tag}{' link' if link else ''}{' outside' if within is False and not of else ''}"


def best_region(page: Page, weights: Weights) -> tuple[int, int]:
    """First block and the one behind the last of the contiguous region with the largest score, in one pass.

    Of equal regions the first in page order counts, of those with one start the shortest; without a positive score, none.
    """
    best, region, score, start = 0.0, (0, 0), 0.0, 0
    for i, context in enumerate(page.contexts):
        if score > 0:
            score -= sum(weights.tag(t) for t in page.between[i])
        if score <= 0:
            score, start = 0.0, i
        gain = sum(weights.word(c) * n for c, n in context.items())
        # Words of other parts gain next to nothing; a region doesn't begin with them.
        score += gain if page.kinds[i] is None else min(gain, 0.01)
        if score > best:
            best, region = score, (start, i + 1)
    return region


def extract(source: str | None, weights: Weights) -> str:
    """The blocks of the best region that aren't in other parts of the page, a line each."""
    page = Page(source or "")
    start, end = best_region(page, weights)
    return "\n".join(t for t, of in zip(page.texts[start:end], page.kinds[start:end], strict=True) if of is None)


def learn(pages: Iterable[str]) -> Iterator[tuple[str, str, int, int]]:
    """``what, name, inside, outside``: where words and tags of labelled pages stand. The label of a page is its only article."""
    seen: dict[tuple[str, str], list[int]] = {}
    for source in pages:
        page = Page(source)
        if page.articles != 1:
            continue
        inside_before = False
        for context, tags, inside in zip(page.contexts, page.between, page.inside, strict=True):
            for place, n in context.items():
                seen.setdefault(("word", word_key(place)), [0, 0])[not inside] += n
            for tag in tags:  # between two blocks of the article, or else outside
                seen.setdefault(("tag", tag), [0, 0])[not (inside and inside_before)] += 1
            inside_before = inside
    for (what, name), (inside, outside) in seen.items():
        yield what, name, inside, outside


def fit(pages: DataFrame, rows: int = TRAINING_PAGES, chars: int = TRAINING_CHARS) -> Weights:
    """Weights from at most ``rows`` labelled pages of at most ``chars`` characters, chosen by a hash of the id.

    A page is labelled if it marks its main text as its only ``article`` element; the names of elements count, not the words.  Pages
    without an id or a text aren't learnt from; of rows with one page_id, one is.  Without labelled pages the weights are those believed before.
    """
    small_batches(pages.sparkSession)
    labelled = pages.where("page_id is not null").where(F.length("html") <= chars).where(F.regexp_count("html", F.lit("(?i)<article[\\s>]")) == 1)
    chosen = labelled.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(rows)
    texts = labelled.select("page_id", "html").join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.max("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(learn(source for batch in batches for source in batch.column("html").to_pylist()))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["what", "name", "inside", "outside"])

    found = texts.select("html").mapInArrow(run, "what string, name string, inside long, outside long")
    # Names of elements that HTML doesn't know are left out, so that what comes to the driver is bounded.
    found = found.where(F.regexp_extract("name", r"^/?([a-z0-9]+)", 1).isin(sorted(BLOCKS | VOID | set(KINDS) | {"hidden", "markup", "span", "a", "b", "i"})))
    counts = found.groupBy("what", "name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return Weights({(r["what"], r["name"]): (r["inside"], r["outside"]) for r in counts})


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html)``.

    Words score for a region and tags against it, by where such words and tags stand in labelled pages; the region with the largest
    score is kept, without menus, headers, footers, sidebars, notices, adverts, forms, comments and whatever isn't shown.  Character
    references are decoded, white space inside a block becomes one space, blocks are lines in page order.

    A null or empty html, or one without words, has an empty text; ids and urls stay as they are, null or not; repeated rows stay and
    have equal texts; an empty table gives an empty one; other columns are ignored.  Texts are read whole, whatever their length.
    """
    found = weights or fit(pages)
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            at = held = 0
            for i, source in enumerate(batch.column("html").to_pylist()):
                texts.append(extract(source, found))
                held += len(source or "")
                if held > HELD_CHARS or i == batch.num_rows - 1:
                    ids = [batch.column(c).slice(at, len(texts)) for c in ("page_id", "url")]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                    at, texts, held = i + 1, [], 0

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
