"""HTML extraction: block rules in two passes.

The page is cut into blocks at block-level tags. Pass one adds up what speaks for a block
being text and what against, for every block of every page:

* stop words: a share of DENSE or more of its words counts +1, one of SPARSE or less -1,
  shares between them in proportion; a block of fewer than LONG words counts in proportion
  to its length. On a page with hardly any known stop word, as in a language that is not
  listed, they count nothing;
* links: a block that consists mostly of links counts against it, but not in an article;
* area: a block in a menu, header, footer, sidebar, form, notice, advert or comment area
  counts far against; one in the page's article or main element somewhat for it, and one
  beside that element somewhat against.

From DECIDED on the block is text, down from -DECIDED it is boilerplate. Short and mixed
blocks stay undecided. Pass two gives an undecided block the label of its nearest decided
neighbour: the distance is the number of blocks, and BORDER more for each border of an area
between them. A heading looks ahead first. Blocks in a menu, advert or the like say
nothing of their neighbours, and neither do the blocks on the other side of the article's
border. Where no neighbour is decided, a block is text, unless it is beside an article.

Every page is read by itself, whole, in one pass over its tags.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from tickloom.llm.common import sliced

#: From this share of characters in links on a block is a list of links.
LINKS = 0.5
#: Words from which a block is long, shares of stop words that speak for and against text, and the share of a page that knows the language.
LONG, DENSE, SPARSE, KNOWN = 12, 0.2, 0.04, 0.02
#: What the areas and a list of links count, the sum that decides, and the distance of a border.
INSIDE, OUTSIDE, BESIDE_COUNTS, LINKED, DECIDED, BORDER = 0.5, -0.5, -4.0, -1.5, 0.8, 3

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to a in is that it for was on are as with be this by from at or an not have but his her they we you
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er sie aus bei
    le la les de des du un une et en est que qui dans pour par sur pas au aux ce il elle avec ne se plus
    el los las y o del una por con para su al lo como más pero sus le ha me sin sobre este ya entre
    """.split()
)
#: Words in class, id or role that mark areas beside the text.
BESIDE = frozenset(
    """
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice alert popup modal overlay newsletter subscribe signup sidebar widget menu nav navbar navigation breadcrumb
    breadcrumbs pagination pager footer comment comments disqus replies reply share sharing social related recommended
    toolbar masthead copyright complementary contentinfo search login
    """.split()
)
#: Elements beside the text, whose content is no text, and that begin a block.
BESIDE_TAGS = frozenset("nav footer aside form button select textarea dialog menu".split())
CONTAINERS = frozenset("nav header footer aside form button select textarea dialog menu article main section div ul ol dl table details fieldset figure blockquote".split())
BLOCK_TAGS = CONTAINERS | frozenset("html body p h1 h2 h3 h4 h5 h6 br hr li dt dd tr td th thead tbody tfoot caption pre address figcaption summary legend option center".split())

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
      |<(?P<silent>script|style|noscript|template|svg|iframe|object|title)\b[^>]*>.*?(?:</(?P=silent)\s*>|\Z)
      |<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?>[^>"']|"[^"]*"|'[^']*')*+)>
      |<[!/?a-zA-Z][^>]*(?:>|\Z)""",
    re.VERBOSE | re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
SPLIT = re.compile(r"[^a-z0-9]+")


WORD = re.compile(r"[^\W_]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    """A block: its text, characters in links, whether it is in an area beside the text or in the article, its tag, how many
    areas are round it, and the fewest that were open since the block before it."""

    text: str
    linked: int
    beside: bool
    inside: bool
    tag: str = "p"
    depth: int = 0
    low: int = 0
    label: bool | None = None


def _marks(rest: str) -> bool:
    """Whether attributes mark an area beside the text, or a hidden one."""
    if not rest or rest.isspace():
        return False
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif not BESIDE.isdisjoint(SPLIT.split(value)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order; empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()
    beside = inside = False
    link, low, now = 0, 0, "body"
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        nonlocal low
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(" ".join(html.unescape(p).split())) for p, own in parts if own)
            out.append(Block(text, linked, beside, inside, now, len(stack), low))
            low = len(stack)
        parts.clear()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], link > 0))
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag, ends = tag.lower(), m.group("end") == "/"
        if tag == "a":
            link = 0 if ends else 1
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        link = 0
        now = "body" if ends else tag
        if ends:
            if opened[tag]:
                own = None
                while own != tag:
                    own, beside, inside = stack.pop()
                    opened[own] -= 1
                low = min(low, len(stack))
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "tr", "td", "th", "dt", "dd")):
            # A paragraph ends at the next block, a row or item at the next of its kind.
            own, beside, inside = stack.pop()
            opened[own] -= 1
            low = min(low, len(stack))
        rest = m.group("rest")
        marked = _marks(rest)
        if rest.endswith("/") or not marked and tag not in CONTAINERS:
            continue
        stack.append((tag, beside, inside))
        opened[tag] += 1
        if tag in ("article", "main"):
            # A menu or header left open ends here; a comment in an area of comments does not begin the text.
            beside = marked or (beside and not any(opened[t] for t in ("nav", "header", "footer", "aside", "form")))
            inside = not beside
        elif tag in BESIDE_TAGS or marked or tag == "header" and not inside:
            beside = True
    if at < len(page):
        parts.append((page[at:], link > 0))
    flush()
    return out


def evidence(found: list[Block]) -> list[float]:
    """Pass one: what the words, links and area of each block say, and the label of those that are decided."""
    words = [WORD.findall(b.text.lower()) for b in found]
    stops = [sum(w in STOP_WORDS for w in own) for own in words]
    known = sum(stops) >= KNOWN * max(1, sum(map(len, words)))
    article = any(b.inside and not b.beside for b in found)
    out = []
    for b, own, n in zip(found, words, stops, strict=True):
        middle = (DENSE + SPARSE) / 2
        density = max(-1.0, min(1.0, (n / len(own) - middle) / (DENSE - middle))) if known and own else 0.0
        total = density * min(1.0, len(own) / LONG)
        if b.beside:
            total += BESIDE_COUNTS
        elif article:
            total += INSIDE if b.inside else OUTSIDE
        if not b.inside and b.linked > LINKS * len(b.text):
            total += LINKED
        b.label = True if total >= DECIDED else False if total <= -DECIDED else None
        out.append(total)
    return out


def neighbours(found: list[Block]) -> tuple[list[tuple[int, int] | None], list[tuple[int, int] | None]]:
    """For each block the nearest decided block before and after it on its side of the article's border, and the distance.

    The areas that two blocks share are the fewest that were open between them, so one
    pass in each direction carries that minimum along.
    """

    def walk(order: range, step: int) -> list[tuple[int, int] | None]:
        out: list[tuple[int, int] | None] = [None] * len(found)
        last: dict[bool, tuple[int, int]] = {}
        for i in order:
            b = found[i]
            if step > 0:  # what was open between this block and the one before it
                last = {side: (j, min(shared, b.low)) for side, (j, shared) in last.items()}
            if b.inside in last:
                j, shared = last[b.inside]
                shared = min(shared, b.depth)
                out[i] = (j, abs(i - j) + BORDER * (b.depth + found[j].depth - 2 * shared))
            if b.label is not None and not b.beside:
                last[b.inside] = (i, b.depth)
            if step < 0:
                last = {side: (j, min(shared, b.low)) for side, (j, shared) in last.items()}
        return out

    n = len(found)
    return walk(range(n), 1), walk(range(n - 1, -1, -1), -1)


def classify(found: list[Block]) -> list[Block]:
    """Both passes; sets label to whether a block is text."""
    total = evidence(found)
    article = any(b.inside and not b.beside for b in found)
    before, after = neighbours(found)
    labels = [b.label for b in found]
    for i, b in enumerate(found):
        if labels[i] is not None:
            continue
        if before[i] is None and after[i] is None:
            b.label = b.inside or not article
        elif before[i] is None or after[i] is None:
            b.label = labels[(before[i] or after[i])[0]]
        else:
            (j, x), (k, y) = before[i], after[i]
            y -= b.tag in HEADINGS
            b.label = labels[k] if labels[j] == labels[k] or y < x else labels[j] if x < y else total[i] > 0
    return found


def main_text(page: str | None) -> str:
    """Text blocks of a page, joined by one space; empty for a null or empty page."""
    return " ".join(b.text for b in classify(blocks(page)) if b.label) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages (html, ...) -> the same columns without html, with text and n_chars (code points).

    A null or empty page has an empty text, no rows give none. Columns named text or
    n_chars are replaced; repeated rows get alike texts. Time and memory are in proportion
    to a page's length, however deep its tags are nested.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars", column)]
    schema = StructType([pages.schema[c] for c in keep]).add("text", StringType()).add("n_chars", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column):
            texts = [main_text(x) for x in batch.column(column).to_pylist()]
            own = [batch.column(c) for c in keep]
            yield pa.record_batch([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, column).mapInArrow(run, schema)
