"""Tag-path ratios: a plain version by path strings, realistic shapes, very long pages."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from weblathe.llm import html_text as h


class Plain(HTMLParser):
    """Well-formed pages only: (path of labels, text, characters in links) of each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.text, self.links, self.in_link, self.skip, self.out = [], "", 0, False, 0, []

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.out.append((tuple(self.path), text, min(self.links, len(text))))
        self.text, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in h.RAW | h.SKIPPED:
            self.skip += 1
        elif self.skip:
            pass
        elif tag == "a":
            self.in_link = True
        elif tag == "br":
            self.text += " "
        elif tag not in h.INLINE:
            self.flush()
            self.path.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag in h.RAW | h.SKIPPED:
            self.skip -= 1
            self.text += " "
        elif self.skip:
            pass
        elif tag == "a":
            self.in_link = False
        elif tag not in h.INLINE and tag != "br":
            self.flush()
            self.path.pop()
            self.in_link = False

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            if self.in_link:
                self.links += len(data.strip())


def plain_text(page):
    """Main text by definition: every ratio anew from all blocks of the page."""
    parser = Plain()
    parser.feed(page)
    parser.flush()

    def speaks_against(i, path):
        tag, label = path[i]
        headed = tag == "header" and not any(t in h.CONTENT for t, _ in path[:i])
        return tag in h.AWAY_TAGS or headed or (tag != "main" and set(label.split("-")) & (h.COMMENTS | h.HINTS))

    def links_are_text(path):
        inside = [i for i, (tag, _) in enumerate(path) if tag == "article" and not any(speaks_against(j, path) for j in range(i, len(path)))]
        return bool(inside)

    blocks = [(p, t, 0 if links_are_text(p) else n) for p, t, n in parser.out]
    total = sum(len(t) for _, t, _ in blocks)

    def free(held):
        return 1 - sum(n for _, n in held) / sum(len(t) for t, _ in held)

    def fused(held):
        if not held:
            return 0.0
        size, marks = sum(len(t) for t, _ in held), sum(len(h.PUNCTUATION.findall(t)) for t, _ in held)
        return math.sqrt(size / len(held) * (1 + marks / len(held))) * math.log(1 + size) * free(held) ** 2

    def own(path):
        return [(t, n) for p, t, n in blocks if p == path]

    def around(path):
        return [(t, n) for p, t, n in blocks if p[: len(path)] == path and len(p) <= len(path) + 1]

    def prior(path):
        out, content = 1.0, False
        for i, (tag, label) in enumerate(path):
            words = set(label.split("-"))
            if tag in h.CONTENT and not content:
                out *= h.ARTICLE
            if tag in h.HEADINGS:
                out *= h.HEADING
            content |= tag in h.CONTENT
            if tag in h.AWAY_TAGS or (tag == "header" and not content):
                out *= h.AWAY
            elif words & h.COMMENTS and not words & h.STATES:
                out *= h.COMMENTED
            elif words & (h.COMMENTS | h.HINTS):
                share = sum(len(t) for p, t, _ in blocks if p[: i + 1] == path[: i + 1]) / total
                out *= (h.STATED if words & h.STATES else h.HINTED) ** (1 - share)
        return out

    def tree(path):
        return max([fused(own(path))] + [h.BELOW**step * fused(around(path[:-step])) for step in range(1, len(path) + 1)])

    score = []
    for i, (path, _, _) in enumerate(blocks):
        near = [(j, h.KERNEL[abs(i - j)] * (1 if path[:-1] == blocks[j][0][:-1] else h.ACROSS)) for j in range(len(blocks)) if abs(i - j) < len(h.KERNEL)]
        score.append(sum(w * tree(blocks[j][0]) for j, w in near) / sum(w for _, w in near) * free(own(path)) * prior(path))
    least = h.SHARE * sum(s * len(t) for s, (_, t, _) in zip(score, blocks, strict=True)) / max(1, total)
    return "\n".join(t for s, (_, t, _) in zip(score, blocks, strict=True) if s > 0 and s >= least)


def sentence(rng, n):
    return " ".join(rng.choice(["stone", "river", "walks,", "light", "under.", "a", "of", "morning", "&amp;", "é"]) for _ in range(n))


def random_page(rng):
    def element(depth):
        tag = rng.choice(["div", "section", "ul", "article", "nav", "footer", "aside", "p", "p", "p", "h2", "header"])
        label = rng.choice(["", "", "", "ad", "comments", "has-sidebar", "widget", "entry"])
        if tag in ("p", "h2") or depth > 3:
            inner = f"<a>{sentence(rng, 3)}</a>" if rng.random() < 0.3 else ""
            inner += rng.choice(["", "", "<button><b>Share <i>this</i></b></button>", "<svg><text>s</text><svg><g>t</g></svg></svg>", "<math><mi>r</mi><mo>=</mo></math>"])
            return f"<p>{sentence(rng, rng.randrange(1, 60))}<br>{inner} <b>{sentence(rng, 2)}</b></p>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li><a>{sentence(rng, 2)}</a></li>" for _ in range(rng.randrange(1, 6))) + "</ul>"
        return f'<{tag} class="{label}">' + sentence(rng, rng.choice([0, 0, 9])) + "".join(element(depth + 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    return "<html><body>" + "".join(element(0) for _ in range(rng.randrange(1, 7))) + "<script>if (a < b) {}</script></body></html>"


@pytest.mark.parametrize("seed", range(60))
def test_equals_the_plain_version(seed):
    page = random_page(random.Random(seed))
    assert h.main_text(page) == plain_text(page)


def test_scores_choose_the_text(monkeypatch):
    rng = random.Random(3)
    pages = [f"<body><ul>{'<li><a>One</a></li>' * 5}</ul><div>{sentence(rng, 2)}</div><div>{''.join(f'<p>{sentence(rng, 70)}.</p>' for _ in range(5))}</div><p><a>More</a></p>" for _ in range(20)]
    texts = [h.main_text(p) for p in pages]
    assert all("One" not in t and "More" not in t and t.count("\n") >= 4 for t in texts)
    monkeypatch.setattr(h, "scores", lambda paths, blocks: [1.0] * len(blocks))
    assert all(h.main_text(p) != t for p, t in zip(pages, texts, strict=True))


LONG = [f"Paragraph {i} of the story, which has words, commas, and a full stop at its end. " * 3 for i in range(5)]
SITE = """<html><head><title>T</title></head><body><header class="site-header"><a href=/>Site</a><p>The paper of the town, since 1901.</p></header>
<div class="cookie-notice"><p>We use cookies, as others do. Read, and agree.</p><button>Agree</button></div>
<nav><ul><li><a href=1>News</a></li><li><a href=2>Sport</a></li></ul></nav>
<div class="wrap"><div class="post"><h1>The title</h1><p class="lead">A lead, short.</p>%s<h2>A part</h2><ul><li>First, of a list.</li><li>Second one.</li></ul>
<table><tr><td>Cell one</td><td>Cell two</td></tr></table><blockquote><p>Said, by someone.</p></blockquote><p>Ok.</p><figure><img src=x><figcaption>A caption, short.</figcaption></figure></div>
<div class="sidebar"><h3>More</h3><ul><li><a href=4>Other story</a></li></ul><p>Sign up, now, for our letter.</p></div>
<div class="ad-box">Buy, now. Best, cheap.</div><div id="comments"><div class="comment"><p>I liked it, a lot. %s</p></div><div class="comment"><p>Me, too.</p></div></div></div>
<footer><p>&copy; 2024, all rights reserved.</p></footer></body></html>"""


def test_a_site_without_article():
    page = SITE % ("".join(f"<p>{t}</p>" for t in LONG), "It was long. " * 20)
    want = ["The title", "A lead, short.", *(t.strip() for t in LONG), "A part", "First, of a list.", "Second one.", "Cell one", "Cell two", "Said, by someone.", "Ok.", "A caption, short."]
    assert h.main_text(page).split("\n") == want


@pytest.mark.parametrize(
    "page",
    ["<div>x" * 170_000, "<a '" * 250_000, "<div>" * 50_000 + "<p>x" + "</section></p>" * 50_000, "<" * 1_000_000, "<ul><li>x" * 100_000, "<!-- " * 200_000, '<div class="' + "a b " * 250_000 + '">x', "word, " * 200_000, "<button>x<div>" * 70_000, "<svg>" * 100_000 + "</svg>" * 100_000],
    ids=["deep", "quotes", "ends", "signs", "lists", "comments", "classes", "text", "controls", "nested"],
)
def test_very_long_pages_take_seconds(page):
    began = time.process_time()
    h.main_text(page)
    assert time.process_time() - began < 10


STORY = "It was a long walk, past the river, and the light went under. " * 4


@pytest.mark.parametrize("control", ["<button>Share", "<select><option>One", "<object data=x>", "<svg><g>", "<video src=x>", "<audio>", "<canvas>", "<template>", "<noscript>"])
def test_an_unclosed_control_ends_at_the_next_block(control):
    page = f"<body><article><p>One, {STORY}</p>{control}<p>Two, {STORY}</p></article><article><button>Share</button><p>Three, {STORY}</p></article></body>"
    assert [line.split(",")[0] for line in h.main_text(page).split("\n")] == ["One", "Two", "Three"]


def test_nested_controls_go_whole():
    page = f"<article><p>One, {STORY}</p><object><object><p>no</p></object><p>no</p></object><button><div>no<p>no</p></div></button><p>Two <svg><svg><text>no</text></svg>no</svg>three.</p></article>"
    assert h.main_text(page) == f"One, {STORY.strip()}\nTwo three."


def test_text_of_scripts_ends_no_control():
    page = f"<article><button>no <script>'</button>'</script> no</button><p>{STORY}</p><!-- <button> --><p>End.</p></article>"
    assert h.main_text(page) == f"{STORY.strip()}\nEnd."


def test_formulas_stay_in_their_sentence():
    page = f"<article><p>{STORY}</p><p>The area is <math><semantics><mrow><mi>a</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup></mrow><annotation>a=r^2</annotation></semantics></math>, here.</p></article>"
    assert h.main_text(page).split("\n")[1] == "The area is a=r2 , here."


@pytest.mark.parametrize("content", ["article", "main"])
def test_link_lists_of_an_article_stay(content):
    sources = "<h2>Sources</h2><ul><li><a href=1>The first book</a></li><li>Second, <a href=2>a paper</a></li></ul>"
    around = "<ul class=menu><li><a href=3>Home</a></li></ul>"
    inside = "<ul class=related-links><li><a href=4>Other story</a></li></ul><nav><a href=5>Next</a></nav>"
    page = f"<body>{around}<{content}><h1>Title</h1>{f'<p>{STORY}</p>' * 3}{sources}{inside}</{content}><ul><li><a href=6>Elsewhere</a></li></ul></body>"
    assert h.main_text(page).split("\n")[4:] == ["Sources", "The first book", "Second, a paper"]


def test_links_of_a_main_around_articles_count_as_links():
    page = f"<body><main><article><p>{STORY}</p></article><ul><li><a href=1>Other story</a></li><li><a href=2>One more</a></li></ul></main></body>"
    assert h.main_text(page) == STORY.strip()


def test_odd_tables(spark):
    rows = [(1, None, "mine", "x"), (2, "", "mine", "x"), (3, f"<p>{STORY}</p>", "mine", "x"), (3, f"<p>{STORY}</p>", "mine", "x"), (None, "<button>", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, score string")
    got = h.extract_text(pages)
    assert got.columns == ["page_id", "score", "text", "n_chars"]
    assert sorted(r["text"] for r in got.collect()) == ["", "", "", STORY.strip(), STORY.strip()]
    assert h.extract_text(pages.where("page_id = 9")).count() == 0
