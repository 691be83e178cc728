"""Plain reimplementations to compare with, and small odd corpora."""

from __future__ import annotations

import re

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, key long, marks string, seed string"


def shingles(text, k=2):
    w = WORD.findall((text or "").translate(_LOW))
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def near_components(rows):
    """{doc_id: smallest id reachable over links of 0.8 or more}."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def repeated(sequences, length):
    """For each sequence, which of its units lie under a window that starts in two places."""
    seen = {}
    for s in sequences:
        for i in range(len(s) - length + 1):
            w = s[i : i + length] if isinstance(s, bytes) else tuple(s[i : i + length])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for s in sequences:
        hit = [False] * len(s)
        for i in range(len(s) - length + 1):
            w = s[i : i + length] if isinstance(s, bytes) else tuple(s[i : i + length])
            if seen[w] > 1:
                hit[i : i + length] = [True] * length
        out.append(hit)
    return out


def corpus(rng):
    """Texts with copies, near copies, shared passages, repeats within a text, and odd ones."""
    words = ["w%d" % i for i in range(900)] + ["é%d" % i for i in range(60)] + ["the", "of"] * 20
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    out = [None, "", "one", "One", "two words", " \t\n ", "a" * 500, "ab" * 300, text(3000)]
    for _ in range(12):
        base = text(rng.randint(30, 160))
        out += [base] * rng.randint(1, 3)
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            near = list(w)
            for _ in range(rng.randint(1, 3)):
                near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near))
    for _ in range(8):
        out.append(text(rng.randint(5, 40)) + "\n" + passage + " " + text(rng.randint(5, 40)))
    out.append(passage + " x " + passage)
    out.append("\r\n".join(["same line of seven words right here"] * 30))
    return out


def frame(spark, texts, first=0):
    """A documents table with nulls in other columns and columns whose names clash with those used inside."""
    rows = [(first + i, t, None if i % 3 else "en", None if i % 5 == 0 else f"s{i % 4}", None, 7, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, FIELDS)
