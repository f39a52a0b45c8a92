"""Operators that look at documents one by one or by group: against plain versions."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblathe.llm import html_text, lattice, licences, mixing, quality, sharding

from . import brute


# quality rules


def test_base_counts_equal_brute_force(docs, rows):
    want = {r[0]: brute.base_counts(r[1]) for r in rows}
    got = {r["doc_id"]: tuple(r[c] for c in quality.COUNTS) for r in quality.quality_report(docs).collect()}
    assert got == want


def test_base_rule_and_verdict(docs):
    for r in quality.quality_report(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)


def test_label_model_finds_accuracies_and_junk():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.85
    table = {True: [0.01, 0.19, 0.8], False: [0.4, 0.2, 0.4]}
    votes = np.stack([np.where(good, rng.choice([-1, 0, 1], 20_000, p=table[True]), rng.choice([-1, 0, 1], 20_000, p=table[False])) for _ in range(8)], axis=1)
    pattern, count = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel(pattern, count.astype(float))
    assert abs(model.prior - 0.85) < 0.03
    assert np.abs(model.table[0].mean(axis=0) - table[False]).max() < 0.05
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.95


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(1)
    prose = [(i, " ".join(rng.choice("the of and river bank stone walks under light morning people said where".split()) + rng.choice(["", "s", "ing", str(rng.randrange(99))]) for _ in range(120)).capitalize() + ".", True) for i in range(60)]
    junk = [(100 + i, " ".join(f"q{rng.randrange(999)}z{rng.choice(['***', '$$$', '&&&'])}" for _ in range(120)), False) for i in range(8)]
    df = spark.createDataFrame([(i, t) for i, t, _ in prose + junk], "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.keep_good(df).collect()}
    assert not kept & {100 + i for i in range(8)} and len(kept) >= 55


def test_quality_odd_tables(odd, nothing):
    assert quality.quality_report(nothing).count() == 0 and quality.keep_good(nothing).count() == 0
    assert quality.quality_report(odd).count() == 5
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.where("votes <> 'mine'").count() == 0


# sharding


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop():
    keys = [0, 1, -1, 2**40, -(2**63), *range(2, 500)]
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(np.array(keys, dtype=np.int64).view(np.uint64), n).tolist() == [jump(k, n) for k in keys]


def test_shards_sizes_checksums_and_slots(docs, rows):
    got = sharding.shard_documents(docs).collect()
    text = {r[0]: (r[1] or "").encode() for r in rows}
    slots = defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 16), jump(r["doc_id"], 17))
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_odd_tables(odd, nothing):
    assert sharding.shard_documents(nothing).count() == 0
    got = sharding.shard_documents(odd).collect()
    assert sorted(r["slot"] for r in got if r["doc_id"] == 1) == [0, 1, 2] or len({r["shard"] for r in got}) == 1
    assert len(got) == 5
    named = sharding.assign_shards(odd, "text", 4)
    assert named.columns == odd.columns and dict(named.dtypes)["shard"] == "int"


# mixing


def water(children, budget):
    """children: name -> (weight, capacity); exact shares by plain water-filling on fractions."""
    from fractions import Fraction

    open_, left, out = dict(children), Fraction(budget), {}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c <= left * w / total]
        if not full:
            return out | {n: left * w / total for n, (w, _) in open_.items()}
        for n in full:
            left -= (c := open_.pop(n)[1])
            out[n] = Fraction(c)
    return out


def test_budgets_follow_the_tree(spark):
    rng = random.Random(7)
    recipe = mixing.Recipe()
    leaves = {(d, la, s): rng.randrange(1, 2000) for d, ss in recipe.domain_sources.items() for s in ss for la in ("en", "de", "xx") if rng.random() < 0.7}
    rows = [(*k, v) for k, v in leaves.items()]
    budget = sum(leaves.values()) * 6 // 10
    got = {tuple(r)[:3]: r["quota"] for r in mixing.allocate(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), recipe, budget).collect()}
    weight = lambda level, name: recipe.weights[level].get(name, recipe.other[level])
    capacity = lambda *p: sum(v for k, v in leaves.items() if k[: len(p)] == p) * recipe.max_epochs
    domains = water({d: (weight("domain", d), capacity(d)) for d in {k[0] for k in leaves}}, budget)
    for d, share in domains.items():
        langs = water({la: (weight("lang", la), capacity(d, la)) for la in {k[1] for k in leaves if k[0] == d}}, share)
        for la, part in langs.items():
            for s, quota in water({s: (weight("source", s), capacity(d, la, s)) for s in {k[2] for k in leaves if k[:2] == (d, la)}}, part).items():
                assert abs(got[d, la, s] - quota) <= 3
    assert sum(got.values()) == min(budget, sum(leaves.values()) * recipe.max_epochs)


def test_selection_is_a_prefix_of_seeded_epochs(docs, rows):
    import hashlib

    recipe = mixing.Recipe(budget_percent=70)
    counts = mixing.counted(docs, recipe)
    quota = {tuple(r)[:3]: (r["tokens"], r["epochs"], r["rest"]) for r in mixing.leaf_plan(counts, recipe).collect()}
    taken, by_leaf = defaultdict(dict), defaultdict(dict)
    for r in mixing.mix_report(docs, recipe).collect():
        taken[r["domain"], r["lang"], r["source"]][r["epoch"], r["doc_id"]] = r["take_tokens"]
    for r in counts.collect():
        if r["n_tokens"]:
            by_leaf[r["domain"], r["lang"], r["source"]][r["doc_id"]] = r["n_tokens"]
    for leaf, sizes in by_leaf.items():
        _, epochs, rest = quota[leaf]
        want = {(e, i): n for e in range(epochs) for i, n in sizes.items()}
        for i in sorted(sizes, key=lambda i: hashlib.md5(f"42:{epochs}:{i}".encode()).hexdigest()):
            if rest > 0:
                want[epochs, i] = min(sizes[i], rest)
                rest -= want[epochs, i]
        assert taken[leaf] == want


def test_mixing_odd_tables(odd, nothing):
    assert mixing.mix_report(nothing).count() == 0
    assert mixing.mix_report(odd).count() >= 1
    mixed = mixing.mix_documents(odd, mixing.Recipe(max_epochs=1, budget_percent=100))
    assert mixed.columns == odd.columns and mixed.where("text is null").count() == 0


# html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="single comments-open"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
<div class="ad">Buy this, now. Really, buy.</div><article><h1>A &amp; B&#233;</h1><p>First   long paragraph, with <b>bold</b> text,
and <a href="x">a link</a>. It goes on, and on, for a while.<p>Second one&lt;br&gt;.<br>More text here, of course, to read.</p>
<p>Ok.</p><section id="comments"><p>Nice article, thanks, I liked it. Very good.</p></section></article>
<aside><p>Related, other, things.</p></aside><form><p>Your mail.</p><input></form><footer><p>&copy; all, rights.</p></footer></body></html>"""


def test_main_text_of_an_article():
    want = "A & Bé\nFirst long paragraph, with bold text, and a link. It goes on, and on, for a while.\nSecond one<br>. More text here, of course, to read.\nOk."
    assert html_text.main_text(PAGE) == want


BODY = [f"Paragraph {i} of the article, with words, commas, and a full stop at its end. " * 4 for i in range(6)]
MENU = "<div id=top><a href=1>One</a> <a href=2>Two</a></div>"


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_text_beside_the_core_of_the_article_stays():
    lead, end = "A lead, short, but of the article.", "A closing line, as short."
    for first, last in (("<h1>Title</h1>", ""), (f"<p>{lead}</p>", ""), ("", f"<p>{end}</p>"), ("<h1>Title</h1>", f"<div><p>{end}</p></div>")):
        page = f"<body>{MENU}<div id=content>{first}<div class=entry>{paragraphs(BODY)}</div>{last}</div><div><a href=3>Three</a></div>"
        want = [t for t, on in (("Title", "Title" in first), (lead, lead in first)) if on] + [t.strip() for t in BODY] + ([end] if last else [])
        assert html_text.main_text(page).split("\n") == want


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class=no-sidebar", "div class='post comments-open'", "article class=comments-open", "div class=widget"])
def test_hints_do_not_drop_what_wraps_the_article(wrapper):
    page = f"<body>{MENU}<{wrapper}>{paragraphs(BODY)}<div class=sidebar><p>Read, this, too.</p></div></{wrapper.split()[0]}><div class=comments>{paragraphs(['First, I say.'] * 80)}</div>"
    assert html_text.main_text(page).split("\n") == [t.strip() for t in BODY]


def test_main_text_without_semantic_tags():
    body = "".join(f"<p>Paragraph {i} of the story, with commas, and a full stop. It is long enough to count.</p>" for i in range(6))
    page = f"<html><body><div id=top><a href=1>One</a> <a href=2>Two</a></div><div><div><h1>Title</h1>{body}</div></div><div id=x><a href=3>Three</a></div>"
    lines = html_text.main_text(page).split("\n")
    assert lines[0] == "Title" and len(lines) == 7


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<p title='x>y", "&#xFFFFFFF;", "<" * 3000])
def test_broken_markup_does_not_fail(page):
    html_text.main_text(page)


def test_extract_text_odd_tables(spark):
    rows = [(1, "u", PAGE, "mine"), (1, "u", PAGE, "mine"), (None, None, None, None), (2, "v", "", "x")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["n_chars"] for r in got.collect())[:2] == [0, 0]
    assert html_text.extract_text(got.limit(0).withColumn("html", F.lit(""))).count() == 0


# language model


def plain_word(word, pieces, score):
    text = "▁" + word
    at = [0.0] + [-math.inf] * len(text)
    names = dict(zip(pieces.pieces, score, strict=False))
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - pieces.longest), j):
            if text[i:j] in names:
                at[j] = np.logaddexp(at[j], at[i] + names[text[i:j]])
        if text[j - 1] not in names:
            at[j] = np.logaddexp(at[j], at[j - 1] + score[pieces.unknown] - math.log(lattice.CODE_POINTS))
    return at[-1]


def test_forward_recursion_equals_the_sum_over_segmentations():
    pieces = lattice.Pieces(["▁", "a", "b", "ab", "▁a", "aba", "▁ab"])
    words = ["ab", "aba", "abab", "xab", "a", "éb", "bab" * 30, ""]
    got = pieces.log_probability([w.encode() for w in words])
    assert got == pytest.approx([plain_word(w, pieces, pieces.score) for w in words])


def test_expected_uses_are_the_derivative():
    pieces = lattice.Pieces(["▁", "a", "b", "ab", "▁a"])
    words = [b"abab", b"ba", b"aab"]
    uses, base = pieces.expected(words, np.array([1, 2, 3])), pieces.score.copy()
    for k in range(5):
        total = []
        for h in (1e-5, -1e-5):
            pieces.score = base.copy()
            pieces.score[k] += h
            total.append((pieces.log_probability(words) * [1, 2, 3]).sum())
        assert uses[k] == pytest.approx((total[0] - total[1]) / 2e-5, rel=1e-4, abs=1e-6)


@pytest.fixture(scope="module")
def vocabulary(monkeypatch_module):
    letters = [*"▁abcdefghijklmnopqrstuvwxyz0123456789.", "▁w", "w1", "ab", "▁w2"]
    monkeypatch_module.setattr(lattice.Pieces, "load", classmethod(lambda cls, path: cls(letters)))


@pytest.fixture(scope="module")
def monkeypatch_module():
    with pytest.MonkeyPatch.context() as m:
        yield m


@pytest.mark.parametrize("head", [lattice.HEAD_WORDS, 5])
def test_scores_equal_a_plain_version(docs, rows, vocabulary, monkeypatch, head):
    monkeypatch.setattr(lattice, "HEAD_WORDS", head)
    got = {r["doc_id"]: r for r in lattice.lattice_report(docs).collect()}
    train, n_docs = Counter(), 0
    tokens = {r[0]: brute.WORD.findall(brute.lower(r[1])) for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    for i, words in tokens.items():
        if not held[i]:
            train.update(words)
            n_docs += 1
    n, v = sum(train.values()) + n_docs, len(train) + 1
    pieces = lattice.Pieces.load("")
    for _ in range(lattice.ROUNDS):
        uses = np.full(len(pieces.score), 0.01)
        for word, c in train.items():
            for k, x in plain_uses(word, pieces).items():
                uses[k] += c * x
        uses[pieces.end] += n_docs
        pieces.score = np.log(uses / uses.sum())
    for i, words in tokens.items():
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words) + math.log10((n_docs + 1) / (n + v + 1))
        score = (sum(plain_word(w, pieces, pieces.score) for w in words) + pieces.score[pieces.end]) / math.log(10)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(words) + 1, n)
        assert r["n_known"] == sum(w in train for w in words) + 1
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def plain_uses(word, pieces):
    """Expected uses of each piece: prefix and suffix sums over all segmentations (long words in parts)."""
    names = {p: k for k, p in enumerate(pieces.pieces)}
    out = Counter()
    marked = "▁" + word
    for begin in range(0, len(marked), lattice.LONG_CHARS):
        text = marked[begin : begin + lattice.LONG_CHARS]
        arcs = [(i, j, names[text[i:j]], 0.0) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in names]
        arcs += [(i, i + 1, pieces.unknown, -math.log(lattice.CODE_POINTS)) for i, c in enumerate(text) if c not in names]
        arcs = sorted((i, j, k, pieces.score[k] + more) for i, j, k, more in arcs)
        left, right = [0.0] + [-math.inf] * len(text), [-math.inf] * len(text) + [0.0]
        for i, j, _, logp in arcs:
            left[j] = np.logaddexp(left[j], left[i] + logp)
        for i, j, _, logp in reversed(arcs):
            right[i] = np.logaddexp(right[i], right[j] + logp)
        for i, j, k, logp in arcs:
            out[k] += math.exp(left[i] + logp + right[j] - right[0])
    return out


@pytest.mark.parametrize("word", ["ab" * 200, "abxab" * 300, "é" * 5000, "b" * 20_000, "ab" * 131 + "x" + "ba" * 9000])
def test_long_words_equal_the_plain_recursion(word):
    pieces = lattice.Pieces(["▁", "a", "b", "ab", "▁a", "aba", "▁ab", "abab"])
    assert pieces.log_probability([word.encode(), b"ab"])[0] == pytest.approx(plain_word(word, pieces, pieces.score))
    assert pieces.long_word(word.encode(), 7) == pytest.approx(plain_word(word, pieces, pieces.score))
    assert pieces.expected([word.encode()], np.array([1])).sum() > len(word) / 4 - 1


def test_a_word_of_a_million_characters_takes_seconds(vocabulary):
    pieces = lattice.Pieces.load("")
    began = time.process_time()
    value = pieces.log_probability([b"ab1z" * 250_000])
    assert -1e8 < value[0] < -1e5 and time.process_time() - began < 20
    assert pieces.expected([b"ab1z" * 250_000], np.array([2])).sum() > 1e6


def test_lattice_odd_tables(odd, nothing, vocabulary):
    assert lattice.lattice_report(nothing).count() == 0
    got = lattice.lattice_report(odd).collect()
    assert len(got) == 5 and all(r["score"] < 0 for r in got)


# licences


def test_statements_match_their_licence_and_directories_inherit(spark):
    body = "some code that goes on for many words and says nothing at all about any terms of use here\n" * 3
    files = [
        ("/a/LICENSE", "Released under the MIT License.\n" + body),
        ("/a/x.py", body),
        ("/a/b/y.py", "# This work is licensed under the GNU General Public License, version 3.\n" + body),
        ("/a/b/c/z.py", body),
        ("/a/d/COPYING", "Licensed under the Apache License, Version 2.0"),
        ("/a/d/e/f/w.py", body),
        ("/q/r.py", body),
        ("/q/empty.py", ""),
        ("/q/null.py", None),
        ("/q/law.py", "The court read the copyright notice of the other party and all that it had said before\n" + body),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumns({"dir": F.lit("mine"), "licence": F.lit("mine")})
    got = {r["path"]: (r["own_licence"], r["licence"], r["inherited_from"]) for r in licences.scan_licences(df).collect()}
    assert got == {
        "/a/LICENSE": ("mit", "mit", None),
        "/a/x.py": (None, "mit", "/a"),
        "/a/b/y.py": ("gpl-3.0", "gpl-3.0", None),
        "/a/b/c/z.py": (None, "mit", "/a"),
        "/a/d/COPYING": ("apache-2.0", "apache-2.0", None),
        "/a/d/e/f/w.py": (None, "apache-2.0", "/a/d"),
        "/q/r.py": (None, None, None),
        "/q/empty.py": (None, None, None),
        "/q/null.py": (None, None, None),
        "/q/law.py": (None, None, None),
    }


def test_headers_and_licence_texts_match(spark):
    code = "\n\n" + "int value = compute(first, second); // and so on, for the rest of the file\n" * 40
    notice = "/*\n * Copyright (C) 2001 Jane Doe\n *\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version {} of the License, or\n * (at your option) any later version.\n */"
    wrap = lambda text: "\n".join(text[i : i + 70] for i in range(0, len(text), 70))
    mit = f"Copyright (c) 2020 Somebody\n\n{licences.MIT_GRANT}\n\n{licences.MIT_NOTICE}\n\n{licences.MIT_DISCLAIMER}\n"
    bsd = lambda names: f"Copyright (c) 2020, Somebody\n\n{licences.BSD_GRANT}\n\n1. {licences.BSD_SOURCE}\n\n2. {licences.BSD_BINARY}\n\n{names}{licences.BSD_DISCLAIMER}\n"
    files = [
        ("/g/two.c", notice.format(2) + code), ("/g/three.c", notice.format(3) + code), ("/m/terms.txt", mit), ("/m/x/y.c", code), ("/a/h.py", wrap("# " + licences.APACHE_NOTICE) + code),
        ("/b/LICENSE", bsd("")), ("/b/c/LICENSE", bsd("3. " + licences.BSD_NAMES + "\n\n")), ("/b/c/d.c", code), ("/b/d.c", code), ("/g/other.c", code),
    ]
    got = {r["path"]: (r["own_licence"], r["licence"]) for r in licences.scan_licences(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        "/g/two.c": ("gpl-2.0", "gpl-2.0"), "/g/three.c": ("gpl-3.0", "gpl-3.0"), "/m/terms.txt": ("mit", "mit"), "/m/x/y.c": (None, "mit"), "/a/h.py": ("apache-2.0", "apache-2.0"),
        "/b/LICENSE": ("bsd-2-clause", "bsd-2-clause"), "/b/c/LICENSE": ("bsd-3-clause", "bsd-3-clause"), "/b/c/d.c": (None, "bsd-3-clause"), "/b/d.c": (None, "bsd-2-clause"), "/g/other.c": (None, None),
    }


def test_licences_run_no_python(spark, docs, nothing, odd):
    plan = licences.licence_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert licences.licence_report(nothing).count() == 0
    assert licences.licence_report(odd).count() == 5
