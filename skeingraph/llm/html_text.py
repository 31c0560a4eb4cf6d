"""Main text of web pages by two passes of block rules.

A tokenizer for tags (comments, scripts, styles and the like leave at once) splits the page into
blocks of text and notes for each its length, the share of stop words, the share of characters in
links, whether it is a heading, and the containers that it stands in.

Pass 1 decides on each block alone. Containers that say what they are (nav, footer, aside, form, a
header outside articles; or a class, id or role such as ad, sidebar, notice or comments) make their
blocks boilerplate. All other blocks are judged by length, stop-word density and links. On a page
whose text hardly has any of the stop words, its language isn't among theirs, and length and links
decide alone; there a character of a script without spaces counts as `WIDE`. An article or main
element is a prior, whatever it is called (unless it is comments, related or hidden): inside it a
moderate stop-word density is enough, one sign against a block (many links, or no stop words where
the article's other text has them) leaves it undecided, and both signs make it boilerplate. What
stands outside articles is boilerplate only if one article has at least as much content-like text as
all of it. Short blocks stay undecided. Pass 2 gives these the label of the nearest decided
neighbours: content if both are, or the nearer one where they differ; inside an article only
neighbours in the same article count, and without any the block is content; blocks that are mostly
links need content on both sides.

Defined results: null or empty html, and a page without content, give an empty text; malformed
markup never fails (an unclosed tag or comment ends with the page); repeated rows give repeated
results; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skeingraph.llm.shingles import find_words
from skeingraph.runtime import columns_of, map_columns

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ses mais comme ou si leur "
    "el los las que y del se con no una su por para al lo como más pero sus este ya porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)
# Elements by what they do to a page's blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul button iframe noscript object svg template textarea".split()
)
BAD_TAGS = frozenset("nav footer aside form head title button select menu noscript object svg template iframe dialog".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal "
    "nav navbar navigation newsletter notice notices alert pagination pager popup promo promotion related search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# What an article or main element may be called that isn't the page's own; first parts of names that say nothing of the element itself.
NOT_OWN = frozenset("comment comments commentlist disqus related ad ads".split())
STATES = frozenset("has is no not with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.05, 0.12
LINK_LIMIT, MOSTLY_LINKS = 0.33, 0.8
WIDE = 3
SENTENCE_ENDS = ".!?…。！？؟।"

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|textarea|title|xmp|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+[^>]*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)|</[^>a-zA-Z][^>]*+>|<(?=/?[a-zA-Z])[^>]*+\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def says_boilerplate(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is boilerplate, is comments or a part that hides its articles, is an article."""
    if not attributes.strip(" /\n\t\r\f"):
        return tag in BAD_TAGS, False, tag in ("article", "main")
    got = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)}
    role = got.get("role", "").lower()
    tokens = [[p.lower() for p in NAME_PARTS.findall(t)] for k in ("class", "id") for t in got.get(k, "").split()]
    names = {p for parts in tokens if parts and parts[0] not in STATES for p in parts}
    article = tag in ("article", "main") or role in ("main", "article")
    named = bool(names & BAD_NAMES) and tag not in ("body", "html", *HEADINGS)
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    comments = bool(names & NOT_OWN) or hidden
    if article and not comments:
        return False, False, True
    return tag in BAD_TAGS or role in BAD_ROLES or named or hidden, comments, False


class Block:
    __slots__ = ("parts", "linked", "heading", "bad", "article", "text", "label", "links")

    def __init__(self, bad: bool, article: int, heading: bool) -> None:
        self.parts, self.linked, self.heading, self.bad, self.article, self.text, self.label, self.links = [], 0, heading, bad, article, "", None, False


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    stack = [("", False, False, 0, False)]  # tag, boilerplate, hides articles, number of the article, heading
    articles = links = breaks = 0
    block = Block(False, 0, False)

    def close() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                out.append(block)
        block = Block(stack[-1][1], stack[-1][3], stack[-1][4])

    def add(raw: str) -> None:
        nonlocal breaks
        text = entities.unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if links:
            block.linked += len("".join(text.split()))
        if text.strip():
            breaks = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            if m[1]:
                close()
            continue
        tag, closing, attributes = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            breaks += 1
            block.parts.append(" ")
            if breaks == 2:
                close()
        elif tag in BLOCK_TAGS or tag == "span" or tag == "font":
            breaks = 0
            if tag not in ("span", "font"):
                links = 0
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        inline = tag in ("span", "font") and stack[i][1] == stack[i - 1][1]
                        del stack[i:]
                        if not inline:
                            close()
                        break
                else:
                    if tag not in ("span", "font"):
                        close()
                continue
            if stack[-1][0] == "p" and tag not in ("span", "font") or stack[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                stack.pop()
            _, bad, hides, article, heading = stack[-1]
            is_bad, is_hiding, is_article = says_boilerplate(tag, attributes)
            is_bad = is_bad or tag == "header" and not article
            if is_article and not hides and not is_bad:
                articles += 1
                bad, article = False, article or articles
            hides = hides or is_hiding or (is_bad and tag in ("nav", "aside", "footer", "template", "noscript"))
            if tag in VOID_TAGS or attributes.endswith("/") and tag in ("svg", "iframe"):
                close()
                continue
            stack.append((tag, bad or is_bad, hides, article, heading or tag in HEADINGS))
            if tag not in ("span", "font") or stack[-1][1] != stack[-2][1]:
                close()
        elif tag in ("img", "input", "embed"):
            pass
    if at < len(page):
        add(page[at:])
    close()
    return out


def stop_words(text: str) -> tuple[int, int]:
    """How many of the text's words are stop words, and how many words it has."""
    words = find_words(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def length(text: str) -> int:
    """Characters, where those of scripts without spaces count more."""
    return len(text) + (WIDE - 1) * sum("\u2e80" <= c <= "\ud7ff" for c in text) if not text.isascii() else len(text)


def first_pass(blocks: list[Block]) -> None:
    """Sets label to True (content), False (boilerplate) or None (too short, or too little, to tell)."""
    seen = []
    known: dict[int, list[int]] = defaultdict(lambda: [0, 0])  # article -> its stop words and words
    for b in blocks:
        if b.bad:
            continue
        density = b.linked / max(1, len(b.text.replace(" ", "")))
        b.links = density > MOSTLY_LINKS
        size = length(b.text)
        stops, words = stop_words(b.text) if size >= SHORT else (0, 0)
        seen.append((b, density, stops / max(1, words), size))
        if density <= LINK_LIMIT:
            known[b.article][0] += stops
            known[b.article][1] += words
    foreign = sum(s for s, _ in known.values()) < STOP_LOW * sum(w for _, w in known.values())
    weight: dict[int, int] = defaultdict(int)  # article (0: outside) -> its content-like text
    for b, density, share, size in seen:
        linked = density > LINK_LIMIT
        if b.article:
            poor = share < STOP_LOW and known[b.article][0] >= STOP_LOW * known[b.article][1] > 0
            if size >= SHORT and linked and poor:
                b.label = False
            else:
                b.label = None if size < SHORT or linked or poor else True
        elif linked or "©" in b.text and size < LONG:
            b.label = False
        elif size < SHORT:
            b.label = None if not b.linked else False
        elif foreign:
            b.label = True if size >= LONG or b.text[-1] in SENTENCE_ENDS else None
        else:
            b.label = True if share >= STOP_HIGH and (size >= LONG or b.text[-1] in SENTENCE_ENDS) else None if share >= STOP_LOW else False
        if b.label:
            weight[b.article] += size
    articles = {b.article for b, *_ in seen if b.article}
    ruled = bool(articles) and max(weight[a] for a in articles) >= weight[0]
    for b in blocks:
        if b.bad or ruled and not b.article:
            b.label = False


def second_pass(blocks: list[Block]) -> list[bool]:
    """Labels for all blocks; undecided ones follow the nearest decided neighbours."""
    n = len(blocks)
    back: list[tuple[int, bool] | None] = []
    near = None
    for i, b in enumerate(blocks):
        if near and b.article != blocks[near[0]].article:
            near = None
        if b.label is not None and not b.bad:
            near = (i, b.label)
        back.append(near)
    out, near = [False] * n, None
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        if near and b.article != blocks[near[0]].article:
            near = None
        if b.label is not None:
            out[i] = b.label
            if not b.bad:
                near = (i, b.label)
            continue
        before, after = back[i], near
        if b.links:
            out[i] = bool(before and after and before[1] and after[1])
        elif b.heading and not b.article:
            out[i] = bool(after and after[1])
        elif before and after:
            out[i] = before[1] if before[1] == after[1] else b.article > 0 or (before[1] if i - before[0] <= after[0] - i else after[1])
        elif before or after:
            out[i] = b.article > 0 or (before or after)[1]
        else:
            out[i] = b.article > 0
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    first_pass(blocks)
    return "\n".join(b.text for b, keep in zip(blocks, second_pass(blocks), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(keys, urls, sources):
        texts = list(map(main_text, sources))
        return keys, urls, texts, list(map(len, texts))

    return map_columns(columns_of(pages, id_col, url_col, html_col), schema, lambda: run)
