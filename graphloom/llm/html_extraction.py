"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; block-level tags cut the page into lines. Each line has its text, the number of
tags met in it and the region it stands in (an outermost article or main, else the nearest container).
The ratios of text to tags are smoothed with a Gaussian; lines whose smoothed ratio reaches the standard deviation of
the page's ratios form the content cluster, and the cluster decides: if at least half of its text stands in articles or mains,
those that hold some of it are the content; otherwise the smallest region around all that hold a line of
the cluster is (around the only one, if it is one). The content's lines are kept whole and in order, short ones too.

Scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts and comments (by tag, role, class or
id) are never lines. Class words count as names of their own or as the noun of a compound one (`site-footer`, `ad-slot`), not as a part of
another (`has-sidebar`, `related-work`). A form, or an element that only a class, id or role marks, is taken for a plain container after all if it
holds more than half of the page's text while no article or main stands outside, comments never. Headings inside a header of an article stay.
Everything runs page by page in one scan, in memory of one page; a page with such a container is read twice.

Edges: null and empty pages give the empty text; so do pages without any line; truncated pages are read to
their end (an unfinished tag is dropped, unclosed elements end there); very long pages take time in proportion; repeated rows give equal
texts; of regions with equal text all count; an empty table gives an empty result; other columns, whatever their names, are kept only if asked for.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import pieces

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("body section div td center blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article's text.
SKIPPED = frozenset("script style noscript template head title nav aside footer form button select textarea option iframe object svg canvas audio video dialog menu fieldset".split())
#: Words of a class, id or role that mark what isn't the article; comments stay so however long they are.
WORDS = r"ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|complementary|contentinfo|footer\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|share|sharing|social|related|recommend\w*|pagination|pager|widget\w*|toolbar|copyright|login|signup|search|skip|hidden|teasers?"
COMMENTS = r"comments?|commentlist|disqus|repl(?:y|ies)|respond"
#: What may follow such a word within a name, and what at its beginning makes it the name of something else.
PARTS = r"area|articles?|bar|block|body|bottom|box|btns?|buttons?|col|column|container|content|form|grid|group|header|holder|icons?|inner|items?|left|link|links|list|main|outer|panel|placeholder|posts?|primary|right|row|secondary|section|slot|stories|thread|title|top|unit|wrap|wrapper|\d+"
MODIFIERS = r"has|hide|is|no|not|show|shows|with|without"


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|\s)(?!(?:{MODIFIERS})[_-])(?:[^\s_-]+[_-]+)*(?:{words})(?:[_-]+(?:{words}|{PARTS}))*(?=$|\s)")


BOILERPLATE, COMMENT = _names(f"{WORDS}|{COMMENTS}"), _names(COMMENTS)
#: Words that mark a page's header, but the header of an article where it stands in one or names it.
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?=$|[\s_-])")
ARTICLE_HEADER = re.compile(r"(?:^|\s)(?:article|post|entry|story|content|page)[_-]+header(?=$|\s)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Elements inside which an open element of the same kind is another's.
BOUNDS = frozenset("ul ol dl table div section article main body aside nav footer header form blockquote".split()) | CLOSES["tr"]
WEIGHTS = [math.exp(-(d * d) / 2) for d in range(-2, 3)]


class Lines(HTMLParser):
    """lines: (text, tags, region); a region is its number, `strong` holds those that are an article or main. Elements in doubt have the number
    of their start tag: `doubts` has the one around each, `held` the length of the texts in each, and those of `plain` count as containers."""

    def __init__(self, plain: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.strong: set[int] = set()
        self.plain, self.started = plain, 0
        self.doubts: dict[int, int | None] = {}
        self.held: dict[int, int] = {}
        self.doubt: int | None = None
        self.hard = False  # inside what is skipped without doubt
        self.open: dict[str, int] = {}  # elements on the stack by tag
        self.stack: list[tuple[str, bool, int, bool, int | None, bool]] = []  # tag, skipped, then what held before: region, only headings, doubt, hard
        self.skipped, self.region, self.headings = False, 0, False
        self.regions, self.tags = 0, 0
        self.around: dict[int, int] = {}  # the region around a region; body's own has none
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append((text, self.tags, self.region))
            self.tags = 0

    def handle_data(self, data: str) -> None:
        if not self.skipped and (not self.headings or any(self.open.get(h) for h in HEADINGS)):
            self.parts.append(data)
        elif self.doubt is not None and not self.hard:
            self.held[self.doubt] += len(" ".join(data.split()))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.started += 1
        if tag not in BLOCKS and tag not in SKIPPED:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
            elif tag not in VOID and (self.skipped or attrs and (self.hidden(attrs) or self.marked(attrs))):
                self.push(tag, True, hard=True)  # what is inside a skipped element is stacked too, so that its end tags end itself
            return
        self.flush()
        self.tags += 1
        if closes := CLOSES.get(tag):
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth][0] in closes:
                    self.pop(depth)
                    break
                if self.stack[depth][0] in BOUNDS:
                    break
        if tag in VOID:
            return
        if tag in ("article", "main"):
            # An unclosed menu or advert ends where the article begins; comments and sidebars hold articles of their own.
            if self.skipped and not any(s[1] and s[0] in ("aside", "section", "ol", "ul", "li", "article", "footer") for s in self.stack):
                for name, skipped, *_ in self.stack:
                    self.open[name] -= skipped
                self.stack = [s for s in self.stack if not s[1]]
                self.skipped, self.doubt, self.hard = False, None, False
            hidden = bool(attrs) and tag == "article" and self.hidden(attrs)
            skip = self.skipped or hidden or bool(attrs) and tag == "article" and self.marked(attrs) and self.started not in self.plain
            self.push(tag, skip, hard=hidden, doubtful=skip and not hidden, names=self.names(attrs))
            if not skip and self.region not in self.strong:
                self.inside(True)
                self.strong.add(self.region)
            return
        page = tag in ("body", "html")
        hard = tag in SKIPPED and tag != "form" or bool(attrs) and not page and self.hidden(attrs)
        soft = (tag == "form" or bool(attrs) and not page and self.marked(attrs)) and self.started not in self.plain
        skip = self.skipped or hard or soft
        inner = self.region in self.strong
        names = "" if page else self.names(attrs)
        header = tag == "header" or HEADER.search(names) is not None
        own = inner or ARTICLE_HEADER.search(names) is not None
        self.push(tag, skip or header and not own, hard=hard or header and not own, doubtful=soft, names=names)
        if header and own:
            self.headings = True
        if tag in CONTAINERS and not inner:
            self.inside(tag != "body")

    def inside(self, nested: bool) -> None:
        """From here on lines stand in a new region."""
        self.regions += 1
        if nested:
            self.around[self.regions] = self.region
        self.region = self.regions

    def names(self, attrs: list) -> str:
        return " ".join(v.lower() for n, v in attrs if n in ("class", "id", "role") and v)

    def marked(self, attrs: list) -> bool:
        names = self.names(attrs)
        return bool(names) and BOILERPLATE.search(names) is not None

    def hidden(self, attrs: list) -> bool:
        return any(n == "hidden" or n == "aria-hidden" and v == "true" or n == "style" and v and "display:none" in v.replace(" ", "") for n, v in attrs)

    def push(self, tag: str, skipped: bool, *, hard: bool = False, doubtful: bool = False, names: str = "") -> None:
        self.stack.append((tag, skipped, self.region, self.headings, self.doubt, self.hard))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.skipped, self.hard = skipped, self.hard or hard or doubtful and COMMENT.search(names) is not None
        if doubtful and not self.hard:
            self.doubts[self.started], self.held[self.started] = self.doubt, 0
            self.doubt = self.started

    def pop(self, depth: int) -> None:
        self.flush()
        for tag, *_ in self.stack[depth:]:
            self.open[tag] -= 1
        _, _, self.region, self.headings, self.doubt, self.hard = self.stack[depth]
        del self.stack[depth:]
        self.skipped = self.stack[-1][1] if self.stack else False

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in BLOCKS and not self.skipped:
            return
        if tag in BLOCKS:
            self.flush()
        if not self.open.get(tag):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.pop(depth)
                return

    def mistaken(self) -> frozenset[int]:
        """The elements in doubt that hold more than half of the page's text, where no article or main has any."""
        if not self.doubts or any(region in self.strong for _, _, region in self.lines):
            return frozenset()
        for number in sorted(self.doubts, reverse=True):  # an element starts after the one around it
            if (around := self.doubts[number]) is not None:
                self.held[around] += self.held[number]
        total = sum(len(text) for text, _, _ in self.lines) + sum(self.held[n] for n, around in self.doubts.items() if around is None)
        return frozenset(n for n, held in self.held.items() if 2 * held > total)


def parsed(html: str) -> Lines:
    """The page's lines, read again where an element was mistaken for boilerplate."""
    plain: frozenset[int] = frozenset()
    while True:
        parser = Lines(plain)
        parser.feed(html)
        parser.close()
        parser.flush()
        if plain or not (plain := parser.mistaken()):
            return parser


def smoothed(ratios: list[float]) -> list[float]:
    out, n = [], len(ratios)
    for i in range(n):
        total = weight = 0.0
        for d, w in enumerate(WEIGHTS, -2):
            if 0 <= i + d < n:
                total += w * ratios[i + d]
                weight += w
        out.append(total / weight)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = parsed(html)
    lines = parser.lines
    if not lines:
        return ""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _ in lines])
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    content: dict[int, int] = {}
    whole: dict[int, int] = {}
    for (text, _, region), ratio in zip(lines, ratios, strict=True):
        whole[region] = whole.get(region, 0) + len(text)
        content[region] = content.get(region, 0) + (len(text) if ratio >= threshold else 0)
    strong = {r for r in whole if r in parser.strong and content[r]}
    if strong and 2 * sum(content[r] for r in strong) >= sum(content.values()):
        chosen = strong
    else:
        chosen = _around(parser.around, {r for r in whole if content[r]}, set(whole))
    return "\n".join(text for text, _, region in lines if region in chosen)


def _around(around: dict[int, int], held: set[int], regions: set[int]) -> set[int]:
    """The regions inside the smallest one around all those held (outside the only one, if it is one and stands in another); all regions if there is none."""
    count = dict.fromkeys(held, 1)
    for region in range(max(regions), -1, -1):  # a region's number is larger than that of the one around it
        if region in count and region in around:
            count[around[region]] = count.get(around[region], 0) + count[region]
    common = max((r for r, n in count.items() if n == len(held)), default=None)
    if common is None:
        return regions
    if len(held) == 1:
        common = around.get(common, common)
    inside = {common}
    for region in range(common + 1, max(regions) + 1):
        if around.get(region) in inside:
            inside.add(region)
    return regions & inside


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        keep = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])


def extract_text(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with text and n_chars (its code points)."""
    source = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html).alias("html"))
    kinds = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return source.mapInArrow(_texts, f"{kinds}, text string, n_chars long").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
