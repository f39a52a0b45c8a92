"""Plain versions of the operators for small tables."""

import hashlib
import random
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}" if rng.random() < 0.8 else "".join(rng.choice("abcdéü") for _ in range(rng.randint(1, 8))) for _ in range(n)]
    lines, at = [], 0
    while at < n:
        k = rng.randint(4, 20)
        lines.append(" ".join(words[at : at + k]) + ".")
        at += k
    return "\n".join(lines)


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages, junk, nulls, empties and one long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(5, 300)) for _ in range(n)]
    shared = prose(rng, 80)
    for i in range(0, n, 7):
        texts[i] = texts[i][: len(texts[i]) // 2] + shared + texts[i][len(texts[i]) // 2 :]
    for i in range(3, n, 11):
        texts[i] = texts[i - 1]
    for i in range(5, n, 13):
        texts[i] = texts[i - 2].replace("w1", "w2", 1)
    texts[8] = "same line here.\n" * 40
    texts[9] = "ab " * 300
    texts[10] = None
    texts[11] = ""
    texts[12] = " \n\t "
    texts[13] = "HEY!! " * 60
    texts[14] = prose(rng, 6000)
    texts[15] = "x" * 5000
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src9", "src13", None]), len(t or "")) for i, t in enumerate(texts)]


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def repeats(rows, window=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for at in range(len(data) - window + 1):
            if data[at : at + window] in seen:
                gone[at : at + window] = True
            seen.add(data[at : at + window])
        spans = int((np.diff(np.r_[False, gone].astype(int)) > 0).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def simhash(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=2):
    """prints: id -> fingerprint; the least id that links reach."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(rows, items, window=10):
    windows = {}
    for item, text in items:
        words = bench_words(text)
        if words:
            k = min(window, len(words))
            for i in range(len(words) - k + 1):
                windows.setdefault(tuple(words[i : i + k]), set()).add(str(item))
    out = {}
    for i, text in rows:
        words, hit, found = bench_words(text), set(), set()
        for k in {len(w) for w in windows}:
            for at in range(len(words) - k + 1):
                if names := windows.get(tuple(words[at : at + k])):
                    hit |= set(range(at, at + k))
                    found |= names
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out
