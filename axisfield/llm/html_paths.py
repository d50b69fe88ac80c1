"""HTML main-text extraction by tag-path ratios.

A page is a list of text blocks, each with its root-to-leaf path of block tags and link.
Per path, text lengths and punctuation marks are aggregated to two ratios (characters and
marks a block), which are smoothed over paths that are alike and fused to one score. The
threshold on the scores selects paths, and the least element that holds all blocks of selected
paths is the container: its blocks are kept in page order (headings, lists, tables, quotes),
with headings right before it. Out of it go only blocks that are links for the most part,
headings and paragraphs apart, and named elements in which no path is selected.
Elements that are no text of an article by their tag, or hidden, are left out before, unless
they hold most of the page's text in an article or main (a form: most of the text at all).
So are reader comments, which have the ratios of any text and are told by their names alone,
unless they are most of a page without article or main.
A class, id or role that names what is no article text lowers the score of the paths below; an
article or main raises it by its share of the text outside named elements, and lowers it if that
is little (a teaser). Ratios over little text, or of blocks of a few words, say little, so there
these signs count in full; elsewhere they count for less and the ratios decide.

Defined results: a null or empty page and one without text give an empty text; unclosed,
stray and crossed tags are repaired as far as block tags go; nothing is dropped for being
long. Other columns are kept, but those named like a result are replaced.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|([^<]+)|(<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

#: Numeric references: zeros in front, and more digits than any character has.
_ZEROS, _LONG = re.compile(r"&#(?:([xX])0+(?=[0-9A-Fa-f])|0+(?=[0-9]))"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9A-Fa-f]{7,});?")
#: Elements of a path; one below them stands for all between, and has what cuts or names those.
MOST_DEPTH = 128

# fixed values: tags and names of HTML
RAW = frozenset("script style noscript template iframe svg math textarea title xmp".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
#: Where an unclosed script or style ends: only these can't be meant as part of it.
_PAGE_GOES_ON = re.compile(r"</head\b|<body\b|<main\b|<article\b|</body\b|</html\b", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label".split())
NEVER = frozenset("nav footer aside form button select option dialog menu head object canvas audio video fieldset".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol table dl article section main body div button".split())
CONTROLS = frozenset("button select".split())
BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SECTIONS = frozenset("html body article main section div center form header td".split())
#: Whole class tokens, ids or roles that are a weak sign of what is no article text.
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright dialog discussion disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notices alert notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription tags toolbar teaser teasers "
    "widget widgets complementary contentinfo search".split()
)
#: Those of them that are reader comments.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: What is left of a path's score below an element of NAMES that holds little; more if it holds much and no article is elsewhere.
NAMED = 0.05
#: The power of the signs: SIGNS where there is much text, nearly one on pages of far less than ENOUGH characters or, on the path that holds most, far less than A_BLOCK of them a block.
SIGNS, ENOUGH, A_BLOCK = 0.2, 600, 100
#: What a path counts for another, by each tag in which they differ.
ALIKE = 0.1
MARKS = re.compile(r"[.,;:!?…。，、；：！？؟،।]")


def tokens(page: str, kept: frozenset[str] = frozenset()) -> Iterator[tuple[bool, str, str, str]]:
    """(closing, tag, attributes, text) of tags (text "") and text (tag "") in page order.

    The content of a RAW element is no markup: it ends at the element's own end tag, and is
    text if the tag is in `kept`, else left out. Without an end tag, a script or style ends
    where head ends or body, main or article starts or body ends, else with the page; any
    other RAW element is taken as empty.
    """
    at, missing = 0, set()
    while True:
        resume = None
        for m in _TOKEN.finditer(page, at):
            closing, tag, attributes, text, angle = m.groups()
            if text or angle:
                yield False, "", "", text or angle
                continue
            if not tag:
                continue
            tag = tag.lower()
            yield bool(closing), tag, attributes, ""
            if tag not in RAW or closing or attributes.endswith("/") and tag in ("svg", "math"):
                continue
            end = None if tag in missing else _RAW_END[tag].search(page, m.end())
            if end:
                resume = end.start()
            elif tag in ("script", "style"):
                missing.add(tag)
                goes_on = _PAGE_GOES_ON.search(page, m.end())
                resume = goes_on.start() if goes_on else len(page)
            else:
                missing.add(tag)
                continue
            if tag in kept and resume > m.end():
                yield False, "", "", page[m.end() : resume]
            break
        if resume is None:
            return
        at = resume


@dataclass
class Block:
    path: tuple[str, ...]  # tags; one whose name is a sign of other than article text ends with !
    text: str
    link: int  # characters inside links
    within: tuple[int, ...]  # the elements of the path, by their number in page order
    weight: float = 1.0  # of the signs: by what its article or main and its named elements hold


@dataclass
class Element:
    tag: str
    cut: bool  # left out by its tag, as hidden or as comments
    named: bool
    comments: bool = False


def _signs(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, whether a class token, id or role is one of NAMES or made of them alone (cookie-notice), and whether one of COMMENTS is in that."""
    hidden = named = comments = False
    seen = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in seen:
            continue
        seen.add(name)
        if name == "hidden":
            hidden = hidden or value.lower() != "until-found"
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
        elif name in ("class", "id", "role"):
            for t in value.lower().split():
                parts = re.split("[-_]+", t)
                if NAMES.issuperset(parts):
                    named, comments = True, comments or not COMMENTS.isdisjoint(parts)
    return hidden, named, comments


def attribute(attributes: str, name: str) -> str | None:
    """The value of an attribute by its whole name, references decoded; the first counts."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == name:
            return decoded(m[2] or m[3] or m[4] or "")
    return None


def decoded(text: str) -> str:
    """Character references decoded; a number of any length, which is no character beyond seven digits, is U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_LONG.sub("\ufffd", _ZEROS.sub(lambda m: f"&#{m[1] or ''}", text)))


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, without what is no article text by its element."""
    found: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    links = in_link = 0
    depths: dict[str, int] = defaultdict(int)  # open elements by tag
    known: dict[tuple[str, ...], tuple[str, ...]] = {}
    control: tuple[str, int, int] | None = None  # an open control inside a block's text: tag, parts and links before it

    def flush() -> None:
        nonlocal links
        text = " ".join(decoded("".join(parts)).split())
        if text:
            top = stack if len(stack) <= MOST_DEPTH else [*stack[: MOST_DEPTH - 1], stack[-1]]
            path = tuple(t for t, _ in top)
            found.append(Block(known.setdefault(path, path), text, links, tuple(e for _, e in top)))
        parts.clear()
        links = 0

    def close(to: int) -> None:
        for t, _ in stack[to:]:
            depths[t] -= 1
        del stack[to:]

    for closing, tag, attributes, text in tokens(page):
        if text:
            parts.append(text)
            if in_link:
                links += len(decoded(text).strip())
            continue
        if tag in RAW:
            continue
        if tag == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE or tag in VOID and tag != "hr":
            continue
        if control:
            # what a control holds is no text of the block around it
            if tag in ("option", "optgroup"):
                continue
            name, size, before = control
            del parts[size:]
            links, control = before, None
            if closing and tag == name:
                continue
            if not closing and tag not in CONTROLS:
                # a control with blocks is an element, with all that it holds
                flush()
                depths[name] += 1
                stack.append((name, len(elements)))
                elements.append(Element(name, True, False))
        elif not closing and tag in CONTROLS and parts and len(stack) < MOST_DEPTH:
            control = tag, len(parts), links
            continue
        flush()
        if closing:
            if depths[tag]:
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                close(at)
            continue
        if tag == "hr":
            continue
        if stack and stack[-1][0] == "head":
            close(len(stack) - 1)  # its end tag may be omitted
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS_CLOSE_P else set())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in closes:
                close(k)
                if tag not in ("tr", "dt", "dd"):
                    break
            elif stack[k][0] in SCOPES:
                break
        in_link = 0
        hidden, named, comments = _signs(attributes) if attributes and tag not in ("html", "body") else (False, False, False)
        cut = hidden or tag in NEVER or tag == "header" and not (depths["article"] or depths["main"])
        if len(stack) >= MOST_DEPTH:
            above = elements[stack[-1][1]]
            cut, named, comments = cut or above.cut, named or above.named, comments or above.comments
        depths[tag] += 1
        stack.append((tag, len(elements)))
        elements.append(Element(tag, cut or comments, named, comments and not cut))
    if control:
        del parts[control[1] :]
    flush()
    return _kept(found, elements)


def _kept(found: list[Block], elements: list[Element]) -> list[Block]:
    """The blocks outside cut elements, named elements marked in their paths, once it's known what each element holds."""
    holds, of_articles, articles = defaultdict(int), defaultdict(int), set()
    for b in found:
        size, inner = len(b.text), max((k for k, e in enumerate(b.within) if elements[e].tag in ("article", "main")), default=0)
        articles.update(b.within[:inner])
        for k, e in enumerate(b.within):
            holds[e] += size
            of_articles[e] += size if k < inner else 0
    total = sum(len(b.text) for b in found)
    half = total / 2
    any_article = any(e.tag in ("article", "main") and not e.cut for e in elements)
    for e, element in enumerate(elements):
        if element.cut and (of_articles[e] > half or (element.tag in ("form", "fieldset") or element.comments and not any_article) and holds[e] > half):
            element.cut = False
        if element.named and element.tag not in ("article", "main") and e in articles:
            element.named = False
    kept = [b for b in found if not any(elements[e].cut for e in b.within)]
    plain, has_article = 0, False
    for b in kept:
        if not any(elements[e].named for e in b.within):
            plain += len(b.text)
            has_article = has_article or any(elements[e].tag in ("article", "main") for e in b.within)
    for b in kept:
        around = next((e for e in reversed(b.within) if elements[e].tag == "article"), None)
        if around is None:
            around = next((e for e in reversed(b.within) if elements[e].tag == "main"), None)
        if around is not None:
            b.weight = 0.5 + 4.5 * min(1.0, holds[around] / max(1, plain)) ** 2
        if names := [holds[e] for e in b.within if elements[e].named]:
            b.weight *= NAMED * (1.0 if has_article else 1.0 + 3.0 * max(names) / total)
        b.path = tuple(t + "!" if elements[e].named else t for t, e in zip(b.path, b.within, strict=True))
    return kept


def _smoothed(values: dict[tuple[str, ...], list[float]]) -> dict[tuple[str, ...], list[float]]:
    """For each path, sums over all paths that fall to a tenth with each tag by which two differ after their common part.

    Paths form a tree by their prefixes, and that is the distance in it: one pass to the root and one
    back give all sums, in time that grows with the tags of the different paths, MOST_DEPTH each at most.
    """
    width = len(next(iter(values.values()), []))
    below = {(): [0.0] * width}
    for path, own in values.items():
        for k in range(len(path) + 1):
            below.setdefault(path[:k], [0.0] * width)
        below[path] = [a + b for a, b in zip(below[path], own, strict=True)]
    order = sorted(below, key=len)
    for path in reversed(order[1:]):
        below[path[:-1]] = [a + ALIKE * b for a, b in zip(below[path[:-1]], below[path], strict=True)]
    near = {(): below[()]}
    for path in order[1:]:
        near[path] = [b + ALIKE * (up - ALIKE * b) for b, up in zip(below[path], near[path[:-1]], strict=True)]
    return near


def fused(characters: float, marks: float) -> float:
    """One score from the two ratios of a path: characters and marks a block."""
    return characters * (0.25 + marks)


def selected(page: list[Block], share: float = 0.2) -> set[tuple[str, ...]]:
    """Paths whose fused score reaches a share of the best."""
    lengths, marks, weights, count = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(int)
    for b in page:
        # link text counts against a path
        lengths[b.path] += max(0, len(b.text) - 2 * b.link)
        marks[b.path] += len(MARKS.findall(b.text)) if 2 * b.link < len(b.text) else 0
        weights[b.path] += b.weight
        count[b.path] += 1
    paths = list(count)
    # characters and marks a block, each path with the root of its blocks as its weight
    near = _smoothed({p: [count[p] ** 0.5, lengths[p] / count[p] ** 0.5, marks[p] / count[p] ** 0.5] for p in paths})
    top = max(paths, key=lengths.__getitem__, default=None)
    evidence = min(sum(lengths.values()) / ENOUGH, lengths[top] / count[top] / A_BLOCK) if paths else 0.0
    power = SIGNS + (1.0 - SIGNS) / (1.0 + evidence * evidence)
    scores = {}
    for p in paths:
        total, ratio, punctuation = near[p]
        scores[p] = fused(ratio / total, punctuation / total) * (weights[p] / count[p]) ** power
    best = max(scores.values(), default=0.0)
    return {p for p in paths if scores[p] >= share * best and (best or scores[p])} or set(paths)


def _heading(b: Block) -> bool:
    return bool(b.path) and b.path[-1].rstrip("!") in HEADINGS


def contained(page: list[Block], chosen: set[tuple[str, ...]]) -> list[Block]:
    """The blocks of the container of all chosen paths, without those that are no text by their own evidence."""
    at = [k for k, b in enumerate(page) if b.path in chosen]
    if not at:
        return []
    common = page[at[0]].within
    for k in at:
        same = 0
        for a, b in zip(common, page[k].within):
            if a != b:
                break
            same += 1
        common = common[:same]
    # a leaf, its list or its table is no container by itself
    depth = len(common)
    while depth and page[at[0]].path[depth - 1].rstrip("!") not in SECTIONS:
        depth -= 1
    inside = [k for k, b in enumerate(page) if b.within[:depth] == common[:depth]]
    first = inside[0]
    while first and _heading(page[first - 1]) and not any(t.endswith("!") for t in page[first - 1].path):
        first -= 1
    inside = [*range(first, inside[0]), *inside]
    # named elements inside the container are kept whole if one of their paths is chosen
    open_names = {e for k in at for e in page[k].within}
    kept = [page[k] for k in inside if not any(t.endswith("!") and e not in open_names for t, e in zip(page[k].path[depth:], page[k].within[depth:]))]
    return [b for b in kept if 2 * b.link <= len(b.text) or _heading(b) or b.path and b.path[-1] in PARAGRAPHS] or kept


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b in contained(found, selected(found)))


def extract(pages: DataFrame, source: str = "html", into: str = "text") -> DataFrame:
    """Adds the main text of each whole page."""
    kept = [f for f in pages.schema if f.name not in (into, source)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [main_text(x.as_py() or "") for x in some.column(source)]
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), into])

    return pages.select(*(F.col(f"`{f.name}`") for f in kept), source).mapInArrow(run, T.StructType([*kept, T.StructField(into, T.StringType())]))
