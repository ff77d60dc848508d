"""Main text of web pages: two passes over blocks by stop words, length and links."""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftlake.llm.common import arrow_map, without

# Stop words of the languages read, in alphabetical order.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from he in is it of on or that the this to was were which will with
    au aux avec ce ces dans de des du elle en est et il la le les mais ne ou par pas pour qui que se sur un une
    aber als auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie und von wie zu
    al como con del el ella en es la las lo los más no para pero por que se su sus un una y
    """.split()
)
# Element names by their role.
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre
    section summary table tbody td tfoot th thead tr ul
    """.split()
)
DROPPED = frozenset(
    """
    button canvas datalist embed iframe input noframes noscript object script select style svg template
    textarea title
    """.split()
)
FURNITURE = frozenset("aside dialog footer form menu nav".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in a class, id or role that name page furniture.
FURNITURE_WORDS = frozenset(
    """
    ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies
    copyright disqus footer login masthead menu nav navbar navigation newsletter notice notices pagination pager popup
    promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored
    subscribe subscription toolbar widget widgets
    contentinfo complementary search
    """.split()
)

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
WORD = re.compile(r"[^\W\d_]+")

# Thresholds of the rules: characters of a short and a long block, shares of stop words, share of
# characters inside links.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.30, 0.32
LINKS = 0.2

OUT = ["text", "n_chars", "n_blocks"]


class Block:
    """Text between block borders, with what the rules look at."""

    __slots__ = ("article", "furniture", "heading", "kind", "linked", "parts", "suspect", "text")

    def __init__(self, furniture: bool, article: int, heading: bool, suspect: int):
        self.parts: list[str] = []
        self.linked = 0
        self.furniture, self.article, self.heading, self.suspect = furniture, article, heading, suspect
        self.text, self.kind = "", ""


#: What attributes say of an element: nothing, furniture by a part of a name, furniture.
PLAIN, SUSPECT, SURE = 0, 1, 2


def _names_furniture(attributes: str) -> int:
    """`SURE` where a whole name in class, id or role is made of furniture words, or the element isn't shown (hidden,
    aria-hidden=true, display:none); `SUSPECT` where a name has such a word among others."""
    out = PLAIN
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id", "role"):
            for one in value.split():
                words = {w for w in re.split(r"[^A-Za-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower()) if w}
                if words and words <= FURNITURE_WORDS:
                    return SURE
                if not FURNITURE_WORDS.isdisjoint(words):
                    out = SUSPECT
        elif name == "hidden":
            if value.strip().lower() != "until-found":
                return SURE
        elif name == "aria-hidden":
            if value.strip().lower() == "true":
                return SURE
        elif name == "style" and NO_DISPLAY.search(value):
            return SURE
    return out


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """Blocks with text, in page order, and for each suspect element (from 1) the next one around it (0: none)."""
    out: list[Block] = []
    # Open elements: name, whether the element is furniture, number of its article, innermost suspect (0: none).
    stack: list[tuple[str, bool, int, int]] = []
    opened: Counter = Counter()
    endless: set[str] = set()
    around = [0]
    links, articles, at = 0, 0, 0
    block = Block(False, 0, False, 0)

    def border() -> None:
        nonlocal block
        block.text = " ".join(html.unescape("".join(block.parts)).split())
        if block.text:
            out.append(block)
        top = stack[-1] if stack else ("", False, 0, 0)
        block = Block(top[1], top[2], heading=any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-2:]), suspect=top[3])

    def take(part: str) -> None:
        if part:
            block.parts.append(part)
            if links:
                block.linked += len(html.unescape(part).strip())

    while True:
        m = MARKUP.search(page, at)
        take(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0].startswith("<![CDATA["):
                take(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = name.lower()
        if not closing and name in DROPPED:
            if name not in VOID and not attributes.endswith("/"):
                end = None if name in endless else re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if not end:  # nor will a later one end
                    endless.add(name)
                # An element that never ends takes the rest when its content is no markup.
                at = end.end() if end else len(page) if name in ("script", "style", "textarea", "title") else at
            take(" ")
            continue
        if name == "br":
            take(" ")
            continue
        if name in BLOCKS:
            border()
        if name in VOID:
            continue
        if closing:
            if opened[name]:  # what is closed is looked at once
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    links -= gone == "a"
                    if gone == name:
                        break
                if name in BLOCKS:
                    border()
            continue
        if name == "p":  # paragraphs hold no blocks, so they need no end
            said = _names_furniture(attributes)
            if said == SURE or (said and not block.article):
                block.furniture = True
            continue
        up = stack[-1] if stack else ("", False, 0, 0)
        furniture, article, suspect = up[1:]
        said = _names_furniture(attributes)
        if name in ("article", "main") and said != SURE:
            if not article:  # an article inside an unclosed menu is an article still
                articles += 1
                furniture, article = False, articles
        elif name in FURNITURE or (name == "header" and not article) or said == SURE:
            furniture = name not in ("html", "body") and True
        elif said and not article and name not in ("html", "body"):
            around.append(suspect)
            suspect = len(around) - 1
        if name == "a":
            links += 1
        stack.append((name, furniture, article, suspect))
        opened[name] += 1
        if name in BLOCKS:
            block.furniture, block.article, block.suspect = furniture, article, suspect
            block.heading |= name in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif (furniture and not up[1]) or suspect != up[3]:  # an inline advert is a block of its own
            border()
            block.furniture, block.suspect = furniture, suspect
    border()
    return out, around


def classify(blocks: list[Block], around: list[int]) -> None:
    """Pass one decides by stop words, length and links; pass two lets the ambiguous inherit.

    Kinds after pass one: good, bad, or short (ambiguous). Inside an article element a block that the
    rules would reject for its words alone is ambiguous, and so is one with many links that has words outside
    them. Outside, a block of `SHORT` characters or more with few stop words is ambiguous when it has no links. An ambiguous block takes the label of
    its nearest decided neighbours: of both where they agree, of the nearer one where they don't (good at
    equal distance). Neighbours are sought in the same article, or else among blocks outside
    articles; an article without any decided block is good. Where a page has neither an article nor a
    good block, ambiguous blocks of `SHORT` characters or more without links are good: it may be in another language.

    A suspect element is furniture unless a block in it is good by itself, and never where it holds an article's blocks.
    """
    cleared = {0}
    for b in blocks:
        size = len(b.text)
        words = WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        links = b.linked / size
        if b.furniture or ("\xa9" in b.text and size < LONG and not b.article):
            b.kind = "bad"
        elif links > LINKS:
            b.kind = "short" if b.article and links < 1 - LINKS else "bad"
        elif size < SHORT:
            b.kind = "bad" if links > 0 and not b.article else "short"
        elif stops >= STOPS_HIGH or (stops >= STOPS_LOW and size <= LONG):
            b.kind = "good" if size > LONG or b.article else "short"
        elif stops >= STOPS_LOW:
            b.kind = "good"
        else:
            b.kind = "short" if b.article or not b.linked else "bad"
        suspect = b.suspect if b.kind == "good" else 0
        while suspect not in cleared:
            cleared.add(suspect)
            suspect = around[suspect]
    for b in blocks:
        if b.suspect not in cleared and not b.article:
            b.kind = "bad"
    plain = not any(b.article or b.kind == "good" for b in blocks)
    groups: dict[int, list[Block]] = {}
    for b in blocks:
        # Furniture inside an article decides nothing for the text around it.
        if not (b.article and b.kind == "bad"):
            groups.setdefault(b.article, []).append(b)
    for article, group in groups.items():
        before: list[tuple[str, int]] = []
        last = ("", 0)
        for i, b in enumerate(group):
            if b.kind != "short":
                last = (b.kind, i)
            before.append(last)
        last = ("", 0)
        labels = []
        for i in range(len(group) - 1, -1, -1):
            if group[i].kind != "short":
                last = (group[i].kind, i)
                continue
            (left, at_left), (right, at_right) = before[i], last
            if not left or not right:
                label = left or right or ("good" if article else "bad")
            elif left == right:
                label = left
            else:
                near = (i - at_left) - (at_right - i)
                label = "good" if near == 0 else left if near < 0 else right
            if plain and not group[i].linked and len(group[i].text) >= SHORT:
                label = "good"
            labels.append((group[i], label))
        for b, label in labels:
            b.kind = label


def main_text(page: str | None) -> tuple[str, int]:
    """The good blocks of a page joined by line ends, and their number."""
    blocks, around = blocks_of(page or "")
    classify(blocks, around)
    good = [b.text for b in blocks if b.kind == "good"]
    return "\n".join(good), len(good)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Adds `text`, `n_chars` (code points) and `n_blocks`; input columns of these names give way, and `html`
    is left out.

    Null or empty html gives ''; rows that repeat stay; an empty table gives an empty result; a
    page cut off inside a mark or an element is read as far as it goes.
    """
    pages = without(pages, OUT)
    names = [c for c in pages.columns if c != "html"]
    schema = T.StructType([f for f in pages.schema.fields if f.name != "html"])
    schema = schema.add("text", "string").add("n_chars", "long").add("n_blocks", "long")

    def make():
        def apply(rows: dict[str, list]) -> dict[str, list]:
            found = [main_text(h) for h in rows["html"]]
            return {n: rows[n] for n in names} | {
                "text": [f[0] for f in found],
                "n_chars": [len(f[0]) for f in found],
                "n_blocks": [f[1] for f in found],
            }

        return apply

    return arrow_map(pages, schema, make, rows=100)
