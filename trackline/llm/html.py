"""Main text of web pages by two passes of block rules.

Stop words are learned from the pages, for each language they name: words that WIDESPREAD of its pages use in
blocks which are long enough, unlinked and not in a menu or the like. The tag around these blocks plays no part.
STOP_WORDS are prior knowledge that counts like PRIOR pages, so a small table leans on them and a large one on itself.

Markup cuts a page into blocks. The first pass judges each block by itself: its place (menus, headers,
footers, side boxes, forms and the like are never main text), its link density, its length and its density
of stop words. Blocks too short to judge stay open. The second pass gives them the label of their nearest
decided neighbours: of those in the same container, where it has any, else of the page's. If a page has no good
block, the open ones of a container outside of <article> and <main> are judged as one.

An <article> or <main> is evidence for its blocks: few stop words leave a block in it open instead of bad, its
open blocks look for neighbours inside it only, and between two labels that differ they are good. If
nothing in it is decided, its blocks are good unless the rules find main text outside of all such elements.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page
order. Pages are read twice, where they lie; only counts of words are shuffled, summed up by task before.

Defined results: a null or empty page, or one without main text, gives an empty text; unclosed tags,
comments and scripts end with the page, however long; a page that names no language of two letters belongs to
the language ""; repeated rows give equal results, and count as often as they occur; an empty table gives an empty
table; other columns stay, whatever their names, but those named `text` and `n_chars` are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from string import punctuation

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackline.llm.common import materialise

#: Frequent function words of some languages.
STOP_WORDS = frozenset(
    # English
    "the of and to in a is that for it was on are as with his they at be this have from or had by but not what all were we when your can said there"
    # German
    " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    # French
    " le la les et des en un une du dans est que qui pour pas au sur par plus ce ne se avec sont il"
    # Spanish
    " el los las y una por con para del se no su al lo como más o pero sus".split()
)

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Of these, the ones that hold a block or a part of a list or table; all others contain blocks that belong together.
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr legend caption figcaption summary pre hr center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea select option iframe object svg math canvas audio video title button".split())
#: Elements around everything but main text.
ASIDE = frozenset("nav header footer aside form menu dialog search fieldset head".split())
MAIN = frozenset(("article", "main"))
_ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|popup|modal|newsletter|subscribe|signup|login|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side-bar|widget\w*|footer\w*|header|masthead|comment\w*|disqus\w*|respond|replies|related\w*|recommend\w*|share|sharing|social\w*|pagination|pager|toolbar|skip-link|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.IGNORECASE,
)
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)

#: Characters from which on a block is judged by its own words.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.25, 0.32
#: Up to LONG characters, chance may take most stop words from a block: from this density on it stays open.
STOP_FEW = 0.08
LINKED = 0.34
#: Share of a language's pages that use a stop word, the pages that STOP_WORDS count for, and stop words of a language at most.
WIDESPREAD, PRIOR, VOCABULARY = 0.1, 20, 1000
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
_LANGUAGE = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2})(?![a-z])", re.IGNORECASE)


class _Block:
    __slots__ = ("home", "label", "links", "parts", "place", "region", "whole")

    def __init__(self, place: str | None, region: int = 0, home: int = 0):
        self.whole: str | None = None
        self.parts, self.links, self.place, self.label, self.region, self.home = [], 0, place, "", region, home

    def text(self) -> str:
        if len(self.parts) != 1 or self.parts[0] is not self.whole:
            self.whole = " ".join("".join(self.parts).split())
            self.parts = [self.whole]
        return self.whole


def words_of(text: str) -> list[str]:
    """The words of a text, without marks around them or between them."""
    return [w for w in (x.strip(punctuation) for x in text.lower().split()) if w]


def language(page: str) -> str:
    found = _LANGUAGE.search(page)
    return found[1].lower() if found else ""


def _aside(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in _ASIDE_ROLES):
            return True
        if name in ("class", "id") and _ASIDE_NAMES.search(value):
            return True
    return False


def blocks_of(page: str) -> Iterator[_Block]:
    """The page's blocks with their places: "aside", "main" or None."""
    open_: list[tuple[str, str | None, int, int]] = []
    place: str | None = None
    # The number of the innermost article or main element, and how many there were.
    region = regions = 0
    # The number of the innermost container; 0 outside of all but the body.
    home = homes = 0
    links, at, block = 0, 0, _Block(None)

    def add(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            block.parts.append(text)
            if links:
                block.links += len(text.strip())

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            if name == "title" or name in BLOCKS:
                yield block
                block = _Block(place, region, home)
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            block.parts.append(" ")
        if name not in BLOCKS and name not in MAIN:
            # An inline element can still be a notice, say a span for screen readers only.
            if name in VOID or (not closing and not _aside(m[3])) or (closing and not any(x == name for x, *_ in open_)):
                continue
        yield block
        if closing:
            if any(x == name for x, *_ in open_):
                while open_:
                    x, place, region, home = open_.pop()
                    if x == name:
                        break
        elif name not in VOID:
            if open_ and open_[-1][0] == "p":
                # A paragraph ends where the next block begins.
                _, place, region, home = open_.pop()
            open_.append((name, place, region, home))
            if name in BLOCKS and name not in SINGLE and name not in ("html", "body"):
                homes += 1
                home = homes
            if place != "aside":
                # A header inside an article holds its headline.
                if (name in ASIDE and not (name == "header" and place == "main")) or (name not in ("html", "body") and name not in MAIN and _aside(m[3])):
                    place = "aside"
                elif name in MAIN:
                    place = "aside" if _aside(m[3]) and name != "main" else "main"
                    regions += 1
                    region = regions
        links = 0
        block = _Block(place, region, home)
    yield block


def judge(blocks: list[_Block], stop_words: frozenset[str] = STOP_WORDS) -> None:
    """Label each block good or bad, in two passes."""
    for b in blocks:
        text = b.text()
        if b.place == "aside" or b.links > LINKED * len(text) or "©" in text:
            b.label = "bad"
            continue
        if len(text) < SHORT:
            b.label = "short"
            continue
        words = words_of(text)
        stop = sum(w in stop_words for w in words) / max(1, len(words))
        if stop >= STOP_HIGH or (stop >= STOP_LOW and len(text) > LONG):
            b.label = "good"
        else:
            few = STOP_FEW if len(text) <= LONG else STOP_LOW
            b.label = "short" if stop >= few or b.place == "main" else "bad"
    outside = any(b.label == "good" and b.place != "main" for b in blocks)
    if not any(b.label == "good" for b in blocks):
        # Of a page of short blocks only, a container's are judged as one.
        inside: dict[int, list[_Block]] = {}
        for b in blocks:
            if b.home and b.place is None:
                inside.setdefault(b.home, []).append(b)
        for group in inside.values():
            text = " ".join(b.text() for b in group)
            words = words_of(text)
            if len(text) >= SHORT and all(b.label == "short" for b in group) and sum(w in stop_words for w in words) >= STOP_HIGH * len(words):
                for b in group:
                    b.label = "good"
    # A block's neighbours: those in its container, in its article or main element (less the asides in it), and all.
    # An aside is decided by its place, so it is no neighbour in a container.
    places = [[("home", b.home)] * (b.place != "aside") + [("region", b.region)] * (b.place == "main") + [("page", 0)] for b in blocks]

    def nearest(order: list[int]) -> dict[int, dict[str, str]]:
        last: dict[tuple[str, int], str] = {}
        near = {}
        for i in order:
            if blocks[i].label == "short":
                near[i] = {kind: last.get((kind, k), "") for kind, k in places[i]}
            else:
                last.update(dict.fromkeys(places[i], blocks[i].label))
        return near

    order = list(range(len(blocks)))
    before, after = nearest(order), nearest(order[::-1])
    for i, near in before.items():
        b = blocks[i]
        kind = "region" if b.place == "main" else "home"
        sides = {near[kind], after[i][kind]} - {""}
        if b.place == "main":
            b.label = "good" if "good" in sides or not (sides or outside) else "bad"
        elif sides and (b.home or len(sides) == 1):
            b.label = "good" if "good" in sides else "bad"
        else:
            # Between two labels that differ, a short block goes with the main text only as its heading.
            sides = {near["page"] or "bad", after[i]["page"] or "bad"}
            heading = after[i]["page"] == "good" and len(b.text()) < SHORT
            b.label = "good" if sides == {"good"} or (sides == {"good", "bad"} and heading) else "bad"


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The main text of one page."""
    blocks = [b for b in blocks_of(page or "") if b.text()]
    judge(blocks, stop_words)
    return "\n".join(b.text() for b in blocks if b.label == "good")


def _usage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages of a language, as those of the word "", and those of them that use a word."""
    counts: dict[str, Counter[str]] = {}

    def told() -> pd.DataFrame:
        # The prior words of each language are rows too, so that what no page uses is weighed as well.
        for used in counts.values():
            for w in STOP_WORDS:
                used.setdefault(w, 0)
        langs = [lang for lang, used in counts.items() for _ in used]
        return pd.DataFrame({"lang": langs, "word": [w for used in counts.values() for w in used], "pages": [n for used in counts.values() for n in used.values()]})

    for batch in batches:
        for page in batch["html"]:
            if not page:
                continue
            kept = []
            for b in blocks_of(page):
                if b.place != "aside":
                    text = b.text()
                    if len(text) >= SHORT and b.links <= LINKED * len(text):
                        kept.append(text)
            used = {w.strip(punctuation) for w in set(" ".join(kept).lower().split())}
            used.discard("")
            if used:
                counts.setdefault(language(page), Counter()).update(used | {""})
            if sum(map(len, counts.values())) >= COUNTED:
                yield told()
                counts.clear()
    if counts:
        yield told()


def learned_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """lang, word: the stop words of each language the pages name, VOCABULARY at most. There are 677 languages at most."""
    usage = pages.select(F.col(html).cast("string").alias("html")).mapInPandas(_usage, "lang string, word string, pages long")
    usage = materialise(usage.groupBy("lang", "word").agg(F.sum("pages").alias("pages")), "html-words")
    total = usage.filter("word = ''").select("lang", F.col("pages").alias("n"))
    weight = F.col("pages") + F.when(F.col("word").isin(*sorted(STOP_WORDS)), PRIOR).otherwise(0)
    wide = usage.filter("word <> ''").join(F.broadcast(total), "lang").filter(weight >= (F.col("n") + PRIOR) * WIDESPREAD)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(weight.desc(), "word"))
    return wide.withColumn("place", place).filter(F.col("place") <= VOCABULARY).select("lang", "word")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the html column by `text` and `n_chars` (its code points). The stop words are learned at once."""
    words: dict[str, set[str]] = {}
    for row in learned_words(pages, html).toLocalIterator():
        words.setdefault(row["lang"], set()).add(row["word"])
    words = {k: frozenset(v) for k, v in words.items()}

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, words.get(language(p), STOP_WORDS)) if p else "" for p in batch], dtype=object)

    rest = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    out = pages.select(*rest, read(F.col(html).cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
