"""Main text of web pages by two passes of block rules.

Pass 1 cuts a page into blocks at block-level tags and classifies each by length, density of stop words and of
linked characters, on the evidence of where it stands: good, bad, or ambiguous (near or short). Pass 2 gives each
ambiguous block the label of its nearest decided neighbours, before and after, within the same region; where the two
differ, a good neighbour wins for near blocks and a bad one for short ones. A region that is good or bad itself counts
as a third neighbour.

Evidence: elements and roles of page furniture (menus, headers, footers, sidebars, forms, scripts, styles) are
furniture, which is dropped and decides no neighbour. Classes and ids of furniture (notices, adverts, comments and so
on) make furniture of what is in an article, or in a page that names none; elsewhere such a block is short at best. In
a region that the page names as its article or main part, no block is bad for its links or for few stop
words: it is ambiguous, and the region itself is good. What stands outside such a region must be good by the rules,
since the region around it is bad. In a page without one all is one region, good where nothing is decided; its near
blocks are taken for good if it has no good one; a heading goes with the block that follows. A page whose words
match no list of stop words is in another language: its blocks are classified by length and links alone.

Defined results: null, empty or textless pages give the empty text; unclosed and cut-off tags end at the end of the
page, or at the next block for elements whose end tag may be left out; character references are decoded once; white
space inside a block is one space, blocks are joined by a newline; pages are read whole, whatever their length; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import carried, small_batches

# Common words of the languages looked for.
STOP_WORDS = {
    "en": "a about all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its may more no not of on one or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber alle als am an auch auf aus bei bis da das dass dem den der des die doch durch ein eine einem einen einer es für hat haben ich ihr im in ist ja kann kein man mit nach nicht noch nur oder schon sein seine sich sie sind so um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur über",
    "fr": "a au aussi aux avec c ce ces cette comme d dans de des du elle en est et il ils j je l la le les leur lui mais même n ne nous on ont ou où par pas plus pour qu que qui s sa se ses si son sont sur tout très un une vous y à été être",
    "es": "a al algo como con cual de del desde donde dos el ella en entre era es esta este fue ha hasta hay la las le lo los mas me mi muy más no nos o otra otro para pero por que qué se ser si sin sobre su sus también todo un una uno y ya yo él",
}
_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}

# Element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template iframe svg math canvas object noframes noembed xmp".split())
FURNITURE_TAGS = frozenset("head nav footer aside form menu dialog button select textarea search title header".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset(("article", "main"))
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo related share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
# words that may stand beside those of furniture in a name
PLAIN_WORDS = frozenset(
    "area article articles bar body bottom box block button buttons card col column container content dfp element fixed form global google group inner item items layer left link links list main module outer page panel post posts primary reader readers right row secondary section sticky site slot text thread top unit user users wrap wrapper".split()
)
# elements whose end tag may be left out, and those that end them
ENDS_P = BLOCK_TAGS - frozenset("body caption head html legend optgroup option tbody td tfoot th thead title tr".split())
ENDED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
HOLDERS = frozenset("ul ol dl select table tbody thead tfoot article main body div section".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*|/?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?:[!?]|/?[a-zA-Z])[^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

SHORT = 70
LONG = 200
STOPS_LOW = 0.10
STOPS_HIGH = 0.25
LINKS = 0.35


class Block(NamedTuple):
    text: str
    linked: float  # share of linked characters
    furniture: bool
    named: bool  # a class or id of furniture
    region: int  # 0 outside a named main part
    heading: bool


class _Element(NamedTuple):
    tag: str
    furniture: bool
    named: bool
    region: int


def furniture_name(value: str) -> bool:
    """Whether a class or id names page furniture: one of its names has words of furniture and plain ones only."""
    for name in value.split():
        words = {w.lower() for w in _PARTS.findall(name) if not w.isdigit()} - PLAIN_WORDS
        if words and words <= FURNITURE_WORDS:
            return True
    return False


def _evidence(tag: str, token: str, inside_main: bool) -> tuple[bool, bool, bool]:
    """(is furniture, is named like furniture, is the main part) of an opening tag."""
    bad = tag in FURNITURE_TAGS and not (tag == "header" and inside_main)
    main, named = tag in MAIN_TAGS, False
    if len(token) > len(tag) + 2:
        for m in _ATTR.finditer(token, len(tag) + 1):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                bad |= value.strip().lower() in FURNITURE_ROLES
                main |= value.strip().lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                bad = True
            elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                if inside_main and value.strip().lower() == "header":
                    continue
                if furniture_name(value):
                    named = True
                elif {w.lower() for w in _PARTS.findall(value)} & MAIN_WORDS and tag in ("div", "section", "td"):
                    main = True
    return bad, named, main and not bad and not named


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[_Element] = []
    text: list[str] = []
    linked = links = 0
    regions = 0
    heading = False
    raw_end = None
    pos = 0
    size = len(page)

    def close():
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                top = stack[-1] if stack else _Element("", False, False, 0)
                out.append(Block(joined, min(1.0, linked / len(joined)), top.furniture, top.named, top.region, heading))
            text.clear()
        linked = 0

    while pos < size:
        if raw_end is not None:
            m = re.compile(rf"</{raw_end}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = m.end() if m else size
            raw_end = None
            continue
        m = _TOKEN.match(page, pos)
        token = m[0]
        pos = m.end()
        if token[0] != "<" or len(token) == 1:
            text.append(token)
            if links:
                linked += len(token.strip())
            continue
        named = _NAME.match(token)
        if not named:
            continue
        tag = named[1].lower()
        if token[1] == "/":
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS:
                close()
                heading = heading and tag not in HEADINGS
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if at is not None and not any(stack[i].tag in ("article", "main", "body") for i in range(at + 1, len(stack))):
                close()
                del stack[at:]
            continue
        if tag in RAW_TAGS:
            if not token.endswith("/>"):
                raw_end = tag
            if tag != "noscript":
                text.append(" ")
            continue
        if tag == "a":
            links += 1
            continue
        if tag in BLOCK_TAGS:
            close()
            links = 0
            heading = tag in HEADINGS or heading and tag != "p"
        elif tag == "br":
            text.append(" ")
        if tag in VOID_TAGS:
            continue
        # an unclosed element ends where the next of its kind begins
        ended = [e for e, by in ENDED_BY.items() if tag in by]
        if ended or tag in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ended or stack[i].tag == "p" and tag in ENDS_P:
                    del stack[i:]
                elif stack[i].tag in HOLDERS:
                    break
        top = stack[-1] if stack else _Element("", False, False, 0)
        bad, named, main = _evidence(tag, token, top.region > 0)
        if bad or named or main or tag in BLOCK_TAGS and tag not in ("p", "li", "dt", "dd", "option", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
            close()
            if main and not top.region:
                regions += 1
            stack.append(_Element(tag, bad or top.furniture, named or top.named, regions if main and not top.region else top.region))
    close()
    return out


def stop_density(text: str) -> float:
    """Share of words that are stop words, in the language that has most of them."""
    words = [w.lower() for w in _WORD.findall(text)]
    return max(sum(w in s for w in words) for s in _STOPS.values()) / len(words) if words else 0.0


def other_language(found: list[Block], low=STOPS_LOW) -> bool:
    """Whether what is no furniture has words, but too few stop words of any language."""
    text = " ".join(b.text for b in found if not b.furniture and not b.named)
    return _WORD.search(text) is not None and stop_density(text) < low


def first_pass(block: Block, other=False, elsewhere=False, short=SHORT, long=LONG, low=STOPS_LOW, high=STOPS_HIGH, links=LINKS) -> str:
    """good, bad, near, short or furniture.

    ``other``: the page is in a language without stop words here; ``elsewhere``: it names a main part, so that names
    of furniture outside decide nothing.
    """
    text, inside = block.text, block.region > 0
    if block.furniture or block.named and (inside or not elsewhere):
        return "furniture"
    if block.linked > links and len(text) >= 2:
        return "near" if inside else "bad"
    if not inside and text[:1] == "©":
        return "bad"
    if len(text) < short:
        return "short" if not block.linked or inside else "bad"
    density = high if other else stop_density(text)
    if block.named:
        return "short" if density >= low else "bad"
    if density >= high:
        return "good" if len(text) > long else "near"
    return "near" if density >= low or inside else "bad"


def second_pass(labels: list[str], regions: list[int], headings: list[bool]) -> list[bool]:
    """Whether each block is main text."""
    named = any(r and label != "furniture" for r, label in zip(regions, labels, strict=True))
    if "good" not in labels and not named:
        labels = ["good" if label == "near" and not heading else label for label, heading in zip(labels, headings, strict=True)]
    keep = [label == "good" for label in labels]
    by_region: dict[int, list[int]] = {}
    for i, r in enumerate(regions):
        if labels[i] != "furniture":
            by_region.setdefault(r, []).append(i)
    for region, own in by_region.items():
        outside = named and not region  # itself bad; past the last neighbour of another region all is good
        before: list[str | None] = []
        last = None
        for i in own:
            before.append(last)
            last = labels[i] if labels[i] in ("good", "bad") else last
        after = last = None
        follows = None
        for n in range(len(own) - 1, -1, -1):
            i, after = own[n], last
            last = labels[i] if labels[i] in ("good", "bad") else last
            if labels[i] in ("near", "short"):
                sides = {before[n], after} - {None}
                sides |= {"good"} if region else {"bad"} if outside else set()  # the region's own evidence
                sides = sides or {"good"}
                keep[i] = "good" in sides if labels[i] == "near" or region else "bad" not in sides
                if headings[i] and not region and not outside and follows is not None:
                    keep[i] = follows
            follows = keep[i]
    return keep


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = blocks(page)
    other = other_language(found)
    elsewhere = any(b.region and not b.furniture and not b.named for b in found)
    labels = [first_pass(b, other, elsewhere) for b in found]
    keep = second_pass(labels, [b.region for b in found], [b.heading for b in found])
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of each page; one row in, one row out, no shuffle."""
    small_batches(df.sparkSession, 256)
    columns, work, schema, names = carried(df, keep, "text", "n_chars")
    picked = df.select(*columns, F.col(html_col).cast("string").alias("__html"))

    def rows(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*work, "text", "n_chars"])

    return picked.mapInArrow(rows, f"{schema}text string, n_chars long").toDF(*names)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
