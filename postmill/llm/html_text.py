"""HTML extraction by the maximum-scoring subsequence: words score positive, tags negative, and a linear scan finds the best region.

The weights are log ratios of token kinds inside and outside the content of labelled pages: pages that mark their content
with exactly one article or main element. The label is used there alone: the scan does not see those elements, on any page.
It weighs words by the block that they stand in and whether a link holds them, tags by name and whether they stand by a
link. What lies in menus, adverts and the like inside the region is left out.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import pieces

#: Attributes of a tag. A quote opens a value only after an equals sign; an unclosed one is an ordinary character.
_REST = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(svg)(?=[\s/>]){_REST}(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"
    rf"|<(script|style|noscript|template|textarea|iframe|select|object|canvas|audio|video|annotation|annotation-xml)(?=[\s/>]){_REST}>.*?(?:</\2\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_REST})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text and start another.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose whole content is no main text. A header counts only outside article and main.
NEVER = frozenset("nav aside footer form button menu dialog fieldset".split())
#: Names in class or id that mark such content, alone or beside words that say what or where it is: related-posts is one, related-work is none.
STRONG = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus gdpr masthead nav navbar navigation newsletter pagination popup promo promoted promotion related replies respond share sharing sidebar signup skiplink social sponsor sponsored subscribe subscription".split()
)
WHAT = frozenset("article articles entry form icons notice page post posts reader readers stories story topics user".split())
#: Names that do so alone or beside words for a place: a site-header is one, an article-header is none.
WEAK = frozenset("alert banner consent copyright disclaimer footer header login menu modal notice notices notification overlay pager reply search skip toc toolbar widget widgets".split())
PLACE = frozenset("area bar block bottom box btn button buttons col column container content fixed global group inner item items left link links list main outer page panel primary right secondary section site slot sticky top unit user wrap wrapper".split())
#: Roles of such elements.
ROLES = frozenset("alertdialog banner complementary contentinfo dialog form navigation search".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CONTENT = frozenset(("article", "main"))
#: Elements whose end tag may be left out, and the open ones that their start tag ends.
ENDS = {"option": {"option"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}} | {k: {"td", "th", "tr", "tbody", "thead", "tfoot"} for k in ("tbody", "thead", "tfoot")}
#: Blocks that a list item's start tag looks through for the item before.
THROUGH = frozenset(("address", "div", "p"))
#: Kinds that the weights know: tags by name, text by its place.
KNOWN = BLOCK | VOID | CONTENT | frozenset("a abbr b cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: A word's weight is at least this much positive, a tag's as much negative; beyond that the log ratios stand as learned.
LEAST = 0.1
#: Added to shares before their ratio, so that a kind unseen on one side does not outweigh all others.
SMOOTH = 0.01
#: Used where no page is labelled, and for kinds never seen: a word, a word in a link, a tag that parts blocks; others cost the least.
PLAIN = {"p": -LEAST, "/p": -LEAST, "word": 1.0, "linkword": -0.5, "tag": -0.25, "tag@link": -1.0, "word@title": 0.0}
#: A page's title is in no content: its words count nothing, so that a region never begins there.
FIXED = {"word@title": 0.0}


class Piece:
    """One token of a page: a run of text or a tag, with its kind, and whether it lies in content and in boilerplate."""

    __slots__ = ("block", "boiler", "content", "inside", "kind", "start", "text", "within", "words")

    def __init__(self, kind: str, inside: bool, boiler: bool, text: str = "", words: int = 1, block: bool = False, within: str = "", content: bool = False, start: bool = False):
        self.kind, self.inside, self.boiler, self.text, self.words, self.block, self.within, self.content, self.start = kind, inside, boiler, text, words, block, within, content, start


def _is_mark(name: str) -> bool:
    """Whether one name of a class or id attribute marks boilerplate: each of its parts must be known."""
    parts = [p.lower() for p in NAME_PART.findall(name)]
    if any(p in STRONG for p in parts):
        return all(p in STRONG or p in WEAK or p in PLACE or p in WHAT for p in parts)
    return any(p in WEAK for p in parts) and all(p in WEAK or p in PLACE for p in parts)


def _marked(attributes: str, name: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        if name in ("body", "html") or name in CONTENT:
            continue
        if (key == "role" and value.strip().lower() in ROLES) or (key in ("class", "id") and any(map(_is_mark, value.split()))):
            return True
    return False


def tokens(page: str) -> list[Piece]:
    """The page in order. Malformed markup is read as browsers do in outline: stray end tags are passed over, open elements end with the page."""
    out: list[Piece] = []
    stack: list[tuple[str, bool]] = []  # open block or boilerplate elements and whether each starts boilerplate
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each name stands
    stops: list[int] = []  # where blocks stand, but those of THROUGH
    boiler = content = links = at = 0

    def text(s: str) -> None:
        if s and (n := len(s.split())):
            out.append(Piece("linkword" if links else "word", content > 0, boiler > 0, s, n, within=stack[-1][0] if stack else ""))
        elif s:
            out.append(Piece("", content > 0, boiler > 0, s, 0))

    def close(i: int) -> None:
        nonlocal boiler, content
        for name, bad in stack[i:]:
            boiler -= bad
            content -= name in CONTENT
            places[name].pop()
        del stack[i:]
        while stops and stops[-1] >= i:
            stops.pop()

    def end_before(name: str) -> None:
        """Ends the open elements that a start tag of this name ends: items of the same list, parts of the same table."""
        names = ENDS[name]
        if name in ("li", "dd", "dt"):
            if stops and stack[stops[-1]][0] in names:
                close(stops[-1])
        elif places["table"] and name != "option":
            own = places["table"][-1]
            first = [x[k] for n in names if (x := places[n]) and (k := bisect_right(x, own)) < len(x)]
            if first:
                close(min(first))
        else:
            while stack and stack[-1][0] in names:
                close(len(stack) - 1)

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        end, name, attributes = m[3], m[4], m[5]
        if not name:
            continue
        name = name.lower()
        block = name in BLOCK
        kind = "" if name in CONTENT else ("/" if end else "") + name if name in KNOWN else "inline"
        if block:
            links = 0  # a link that is not closed ends with its block
        if end:
            out.append(Piece(kind, content > 0, boiler > 0, block=block))
            if name == "a":
                links = 0
            if name in places and places[name]:
                close(places[name][-1])
            continue
        if block and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in ENDS:
            end_before(name)
        bad = name in NEVER or (name == "header" and not content) or _marked(attributes, name)
        if name == "a":
            links = 1
        if name not in VOID and (block or bad or name in CONTENT) and not attributes.endswith("/"):
            places[name].append(len(stack))
            if block and name not in THROUGH:
                stops.append(len(stack))
            stack.append((name, bad))
            boiler += bad
            content += name in CONTENT
        out.append(Piece(kind, content > 0, boiler > 0, block=block, content=name in CONTENT, start=True))
    text(page[at:])
    return out


def kinds(page: list[Piece]) -> list[str]:
    """What each piece counts as: text with the block around it, a tag that parts blocks with @link if the text behind its start or before its end is a link."""
    near, last = [""] * len(page), ""
    for order, ends in ((range(len(page)), True), (range(len(page) - 1, -1, -1), False)):
        last = ""
        for i in order:
            if page[i].kind in ("word", "linkword"):
                last = page[i].kind
            elif page[i].block and page[i].kind.startswith("/") == ends:
                near[i] = last
    return [f"{p.kind}@{p.within}" if p.kind in ("word", "linkword") else f"{p.kind}@link" if near[i] == "linkword" else p.kind for i, p in enumerate(page)]


def count_page(page: str | None, inside: Counter, outside: Counter) -> bool:
    """Adds a labelled page's kinds; False if the page has no label. Boilerplate counts as outside, as what it is made of."""
    got = tokens(page or "")
    if sum(p.start and p.block and p.content for p in got) != 1:
        return False
    for p, kind in zip(got, kinds(got), strict=True):
        if p.kind:
            side = inside if p.inside and not p.boiler else outside
            side[kind] += p.words
            if p.kind in ("word", "linkword"):
                side[p.kind] += p.words
    return True


def learn_weights(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Token kind to weight, from all labelled pages. The kinds are a fixed list, so the counts that reach the driver are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for b in pieces(batches, "html"):
            for page in b["html"].to_pylist():
                count_page(page, inside, outside)
        kinds = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "inside", "outside"])

    counts = pages.select(F.col(column).alias("html")).mapInArrow(run, "kind string, inside bigint, outside bigint").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return weights_from({r["kind"]: (r["inside"], r["outside"]) for r in counts.collect()})


def weights_from(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log ratios of a kind's share inside and outside the content; words are kept positive, tags negative, words in links are as they are."""
    a, b = (sum(c[i] for k, c in counts.items() if k not in ("word", "linkword")) for i in (0, 1))
    if not a or not b:
        return PLAIN | FIXED
    out = dict(PLAIN)
    for k, (x, y) in counts.items():
        ratio = math.log(x / a + SMOOTH) - math.log(y / b + SMOOTH)
        word = k.split("@")[0]
        out[k] = max(ratio, LEAST) if word == "word" else ratio if word == "linkword" else min(ratio, -LEAST)
    return out | FIXED


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous part with the greatest sum, the longest of equals; (0, 0) if no sum is positive."""
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best or (run == best and best and i + 1 - start > span[1] - span[0]):
            best, span = run, (start, i + 1)
    return span


def scores(page: list[Piece], weights: dict[str, float]) -> list[float]:
    """The score of each piece. Boilerplate and what is no token count nothing: an advert must not cut off what follows."""
    out = []
    for p, kind in zip(page, kinds(page), strict=True):
        if p.boiler or not p.kind:
            out.append(0.0)
        elif p.text:
            out.append(weights.get(kind, weights[p.kind]) * p.words)
        else:
            out.append(weights.get(kind, (weights["tag@link"] if kind.endswith("@link") else weights["tag"]) if p.block else -LEAST))
    return out


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text: one line per block, white space inside a block as one space. Empty for null, and where no region scores.

    Fallbacks that a browser does not show (in noscript, object, canvas and media elements), drawings and hidden elements are
    no text; formulas are.
    """
    got = tokens(page or "")
    lo, hi = best_region(scores(got, weights))
    lines, line = [], []
    for p in got[lo:hi]:
        if p.block:
            lines.append(line)
            line = []
        elif p.text and not p.boiler:
            line.append(p.text)
    lines.append(line)
    # references are decoded once a block is whole, so that one cut by a comment stays as it is
    return "\n".join(t for t in (" ".join("".join(html.unescape(s) for s in x).split()) for x in lines) if t)


def extract_text(pages: DataFrame, column: str = "html", out: str = "text", weights: dict[str, float] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Adds ``out``, the main text of every whole page (never null), to the columns ``carry`` (all unless given).

    Null or empty html gives an empty text. Weights are learned from the same table unless given. A column named ``out``
    is replaced; rows and their order within a partition stay.
    """
    from pyspark.sql.types import StringType, StructType

    learned = (weights or learn_weights(pages, column)) | FIXED
    keep = [c for c in (pages.columns if carry is None else carry) if c != out]
    schema = StructType([pages.schema[c] for c in keep]).add(out, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, column):
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array([extract(p, learned) for p in b[column].to_pylist()], pa.string())], names=[*keep, out])

    return pages.mapInArrow(run, schema)
