"""Main text of web pages by tag-path ratios (after Wu et al., 2013: CEPR/CEPF).

1. A page is read once, left to right, into blocks of text. Each block has a tag path: the labels of
   the block-level elements from the root to it (tag with the letters of its id and class). Paths
   are numbers in a tree of labels, so elements that repeat (the paragraphs of an article, the
   entries of a menu) share one path.
2. For each path, text length, punctuation and linked text are summed over its blocks; for each
   container, over the blocks in it and directly below. Text per block, punctuation per block, volume
   and the share of text outside links are fused into one ratio.
3. Ratios are smoothed twice: down the tree (a heading, list or table has a part of the ratio of the
   containers around it) and along the page (a Gaussian over neighbouring blocks, less across
   containers). A smoothed ratio counts by the path's share of text outside links.
4. A weak prior weighs each path: articles and headings count for more, what tag, role, class or id
   calls a menu, footer, notice or comment for less. The prior of a class or id fades with the share
   of the page's text that the element holds, so ``has-sidebar`` around an article does no harm.
5. Blocks whose score reaches ``SHARE`` of the page's mean score (weighted by text length) are the
   main text, in page order. Nothing else chooses blocks; only elements that aren't displayed or
   aren't text (scripts, forms' controls, hidden elements) are never read into blocks.

Links inside an article are its text (sources, a table of contents) unless a tag, role, class or id
speaks against them; elsewhere linked text counts against its path. ``main`` counts as the article of a
page that has none. Formulas (``math``) are part of their sentence.

Null or empty html gives an empty text, as does a page without content. Cut-off and misnested markup
is read as browsers do in the cases that occur (an open p ends at the next block, and so on); an
unclosed quote in a tag ends the tag at the next ``>``, from there on quotes aren't heeded. Controls
and media are skipped up to their own end tag, nested ones with them; if the end tag is missing, a
control ends at the next block and a medium at once. Rows are independent: repeated rows and ties
give equal texts, an empty table an empty one; further columns are kept as they are, whatever
their name, but for text and n_chars, which are replaced. Work and memory are linear in the page:
very long and very deep pages are ordinary ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import exp, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

SHARE = 0.25
KERNEL = tuple(exp(-i * i / 2) for i in range(4))  # weight by distance along the page
ACROSS = 0.5  # weight of a neighbour in another container
BELOW = 0.75  # what a path has of the ratio of the container above it

# Names of HTML elements.
RAW = frozenset(("script", "style", "textarea", "title", "iframe"))
CONTROLS = frozenset(("button", "select", "option", "datalist"))
MEDIA = frozenset(("noscript", "template", "svg", "object", "canvas", "audio", "video", "annotation", "annotation-xml"))
INLINE = frozenset(
    (
        "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
        "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "meta", "link", "base", "area",
        "col", "embed", "param", "source", "track", "math", "maction", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded",
        "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder",
        "munderover", "semantics",
    )
)
SKIPPED = CONTROLS | MEDIA
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
STOPS = frozenset(("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "div", "section", "article", "main", "body", "html"))

# What tags, roles and the words of class and id say of an element.
AWAY_TAGS = frozenset(("nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "head"))
AWAY_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"))
HEADERS = frozenset(("header", "site-header", "page-header", "siteheader", "pageheader", "top-header"))
HINTS = frozenset(
    (
        "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "sponsor", "sponsored", "promo", "promotion", "promoted", "banner", "nav",
        "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
        "newsletter", "subscribe", "subscription", "signup", "login", "social", "share", "sharing", "related", "recommended", "recommendations", "popup",
        "modal", "overlay", "widget", "toolbar", "pagination", "pager", "skip",
    )
)
COMMENTS = frozenset(("comment", "comments", "commentlist", "respond", "reply", "replies", "disqus"))
STATES = frozenset(("has", "have", "no", "not", "with", "without", "open", "opened", "closed", "enabled", "disabled", "on", "off", "is"))
# Priors: of tags and roles, of reader comments, of class and id words, of such words with a word of state.
AWAY, COMMENTED, HINTED, STATED, ARTICLE, HEADING = 0.03, 0.02, 0.05, 0.3, 3.0, 3.0

PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
SOME_SKIPPED = re.compile(rf"<(?:{'|'.join(sorted(SKIPPED))})\b", re.I)
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_REST = re.compile(r"[^'\">]*+(?:(?:\"[^\"]*\"|'[^']*')[^'\">]*+)*+>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LETTERS = re.compile(r"[a-z]+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Paths:
    """The tree of labels of a page: one number for each path from the root."""

    def __init__(self) -> None:
        self.parent, self.tag, self.said, self.content, self.hidden = [0], [""], [""], [False], [False]
        self.plain: list[str] = [""]  # the article or main around a path, if nothing inside it speaks against the path
        self.known: dict[tuple[int, str, str], int] = {}

    def below(self, parent: int, tag: str, attributes: str) -> int:
        """The path of an element of this tag under ``parent``."""
        label, said, hidden = described(tag, attributes) if attributes else ("", "", False)
        key = (parent, tag, label)
        path = self.known.get(key)
        if path is None:
            path = self.known[key] = len(self.parent)
            content = tag in CONTENT or self.content[parent]
            if tag in AWAY_TAGS or (tag == "header" and not content):
                said = "away"
            self.parent.append(parent)
            self.plain.append("" if said else "article" if tag == "article" else self.plain[parent] or ("main" if tag == "main" else ""))
            self.tag.append(tag)
            self.said.append(said)
            self.content.append(content)
            self.hidden.append(hidden or self.hidden[parent])
        return path


def described(tag: str, attributes: str) -> tuple[str, str, bool]:
    """An element's label (the letters of id and class, its role), what these say of it, and whether it is hidden."""
    label: list[str] = []
    said: set[str] = set()
    hidden = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for c in value.split():
                words = [w.lower() for w in LETTERS.findall(CAMEL.sub(" ", c))]
                label += words
                if COMMENTS & set(words):
                    said.add("stated" if STATES & set(words) else "comments")
                elif HINTS & set(words) or c.lower() in HEADERS:
                    said.add("stated" if STATES & set(words) else "hinted")
        elif name == "role":
            label.append(value.lower())
            if value.lower() in AWAY_ROLES:
                said.add("away")
        elif name == "hidden":
            hidden |= not m[0].strip().lower().startswith("hidden=false")
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            hidden |= bool(INVISIBLE.search(value))
    if hidden:
        label.append("*")
    if tag in ("html", "body", "main"):
        return "", "", False
    return " ".join(label), next((kind for kind in ("away", "comments", "hinted", "stated") if kind in said), ""), hidden


Block = tuple[int, str, int]  # path, text, characters in links
Token = tuple[str, str, bool, str]  # text before a tag, the tag ("" for a comment or the end), whether it is an end tag, attributes


def tokens(page: str) -> Iterator[Token]:
    """The tags of a page with the text before each; comments, declarations and raw text are left out."""
    at, quotes = 0, True
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            yield page[at:], "", False, ""
            return
        following = page[begin + 1 : begin + 2]
        closing = following == "/"
        name = TAG_NAME.match(page, begin + 1 + closing)
        if not name:
            if page.startswith("<!--", begin):
                yield page[at:begin], "", False, ""
                end = page.find("-->", begin + 2)
                at = len(page) if end < 0 else end + 3
            elif closing or following in ("!", "?"):
                yield page[at:begin], "", False, ""
                end = page.find(">", begin)
                at = len(page) if end < 0 else end + 1
            else:
                yield page[at : begin + 1], "", False, ""
                at = begin + 1
            continue
        before = page[at:begin]
        end = TAG_REST.match(page, name.end()) if quotes else None
        if end:
            at = end.end()
        else:
            quotes = False
            stop = page.find(">", name.end())
            at = len(page) if stop < 0 else stop + 1
        attributes = page[name.end() : at - 1]
        tag = name[0].lower()
        if tag in RAW and not closing and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        yield before, tag, closing, attributes


def ends_of_skipped(page: str) -> dict[int, int]:
    """The number of the end tag, by the number of the start tag, of each control and medium that has both."""
    if not SOME_SKIPPED.search(page):
        return {}
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    for number, (_, tag, closing, attributes) in enumerate(tokens(page)):
        if tag not in SKIPPED and tag not in STOPS:
            continue
        if not closing:
            if not attributes.endswith("/"):
                stack.append((tag, number))
                opened[tag] += 1
        elif opened[tag]:
            # What is open inside the element ends with it, without an end tag of its own.
            while True:
                name, start = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
            if tag in SKIPPED:
                ends[start] = number
    return ends


def blocks_of(page: str) -> tuple[Paths, list[Block]]:
    """The page's blocks of text, white space collapsed and character references decoded."""
    paths, out = Paths(), []
    stack: list[tuple[int, str, Counter]] = [(0, "", Counter())]  # path, tag, open tags since the last of STOPS
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            path = stack[-1][0]
            if text and not paths.hidden[path]:
                out.append((path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())

    def pop() -> str:
        _, tag, scope = stack.pop()
        opened[tag] -= 1
        if tag not in STOPS:
            scope[tag] -= 1
        return tag

    def close(tags: tuple[str, ...]) -> bool:
        """Close the innermost open element of these tags; elements of STOPS are only closed by their own tags."""
        own = tags[0] in STOPS
        count = opened if own else stack[-1][2]
        if not any(count[t] > 0 for t in tags):
            return False
        while pop() not in tags:
            pass
        return True

    ends = ends_of_skipped(page)
    skip, in_control = -1, False  # the number of the end tag to skip to; whether a control without one is open
    for number, (before, tag, closing, attributes) in enumerate(tokens(page)):
        if number <= skip:
            continue
        if not in_control:
            add(before)
        if not tag:
            continue
        if tag in SKIPPED:
            parts.append(" ")
            if number in ends:
                skip = ends[number]
            elif tag in CONTROLS and not attributes.endswith("/"):
                in_control = not closing
        elif tag in RAW or tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = not closing
        elif closing:
            in_control = False
            flush()
            if close((tag,)):
                in_link = False
        else:
            in_control = False
            flush()
            if tag == "hr":
                continue
            if stack[-1][1] == "p":
                pop()
            if tag in ENDS_ITSELF:
                close(ENDS_ITSELF[tag])
            if not attributes.endswith("/"):
                scope = Counter() if tag in STOPS else stack[-1][2]
                stack.append((paths.below(stack[-1][0], tag, attributes), tag, scope))
                opened[tag] += 1
                if tag not in STOPS:
                    scope[tag] += 1
    flush()
    within = ("article",) if "article" in paths.plain else ("main",)
    return paths, [(path, text, 0 if paths.plain[path] in within else links) for path, text, links in out]


class Sums:
    """Text, punctuation, linked text and number of blocks, by path."""

    def __init__(self, n: int):
        self.length, self.marks, self.linked, self.times = [0] * n, [0] * n, [0] * n, [0] * n

    def add(self, path: int, length: int, marks: int, linked: int, times: int) -> None:
        self.length[path] += length
        self.marks[path] += marks
        self.linked[path] += linked
        self.times[path] += times

    def free(self, path: int) -> float:
        """The share of text outside links."""
        return 1 - self.linked[path] / max(1, self.length[path])

    def ratio(self, path: int) -> float:
        """Text per block, punctuation per block, volume and freedom from links, fused."""
        n = self.times[path]
        if not n:
            return 0.0
        return sqrt(self.length[path] / n * (1 + self.marks[path] / n)) * log(1 + self.length[path]) * self.free(path) ** 2


def path_priors(paths: Paths, length: list[int]) -> list[float]:
    """How much tag, role, class and id of a path and the paths above it let its ratio count."""
    out = [1.0] * len(paths.parent)
    fixed = {"away": AWAY, "comments": COMMENTED}
    fading = {"hinted": HINTED, "stated": STATED}
    for path in range(1, len(out)):
        tag, said = paths.tag[path], paths.said[path]
        own = ARTICLE if tag in CONTENT and not paths.content[paths.parent[path]] else HEADING if tag in HEADINGS else 1.0
        if said in fixed:
            own *= fixed[said]
        elif said:
            own *= fading[said] ** (1 - length[path] / max(1, length[0]))
        out[path] = out[paths.parent[path]] * own
    return out


def scores(paths: Paths, blocks: list[Block]) -> list[float]:
    """The smoothed tag-path ratio of each block, weighed by the prior of its path."""
    n = len(paths.parent)
    own, around = Sums(n), Sums(n)
    for path, text, in_links in blocks:
        own.add(path, len(text), len(PUNCTUATION.findall(text)), in_links, 1)
    length = list(own.length)
    for path in range(n - 1, 0, -1):  # a path's number is greater than that of the path above it
        length[paths.parent[path]] += length[path]
    for path in range(n):
        for held in {path, paths.parent[path]}:  # the root is its own parent
            around.add(held, own.length[path], own.marks[path], own.linked[path], own.times[path])
    tree, given = [0.0] * n, [0.0] * n
    for path in range(1, n):
        given[path] = BELOW * max(given[paths.parent[path]], around.ratio(paths.parent[path]))
        tree[path] = max(own.ratio(path), given[path])
    raw = [tree[path] for path, _, _ in blocks]
    inside = [paths.parent[path] for path, _, _ in blocks]
    prior = path_priors(paths, length)
    out = []
    for i, (path, _, _) in enumerate(blocks):
        total = weight = 0.0
        for j in range(max(0, i - len(KERNEL) + 1), min(len(raw), i + len(KERNEL))):
            w = KERNEL[abs(i - j)] * (1 if inside[i] == inside[j] else ACROSS)
            total += w * raw[j]
            weight += w
        out.append(total / weight * own.free(path) * prior[path])
    return out


def main_text(page: str, share: float = SHARE) -> str:
    """The main text of a page, one line for each block."""
    paths, blocks = blocks_of(page)
    value = scores(paths, blocks)
    size = sum(len(text) for _, text, _ in blocks)
    least = share * sum(v * len(text) for v, (_, text, _) in zip(value, blocks, strict=True)) / max(1, size)
    return "\n".join(text for v, (_, text, _) in zip(value, blocks, strict=True) if v > 0 and v >= least)


FOUND = [StructField("text", StringType()), StructField("n_chars", LongType())]


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, with text and n_chars (code points); columns of these names are replaced."""
    names = [f.name for f in FOUND]
    base = pages.drop(*(n for n in names if n != html))
    rest = [f for f in base.schema.fields if f.name != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) if page else "" for page in batch.column(html).to_pylist()]
            columns = [*(batch.column(f.name) for f in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in rest), *names])

    return base.mapInArrow(run, StructType(rest + FOUND))
