from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sloscope.llm import spelling


def brute(rows):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    nearby = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in nearby.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(repr((w, form.get(w), root(w), n[w], len(nearby[w]), n[form[w]] if w in form else None)) for w in n)


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, word string, n int")
    return sorted(repr(tuple(r)) for r in spelling.spelling_variants(docs).collect())


def corpus(seed):
    """Words with chains of rarer variants, runs of one letter, and neighbours in every place."""
    rng = random.Random(seed)
    letters = "abÀÿ"
    words = {}
    for _ in range(25):
        w, n = "".join(rng.choice(letters) for _ in range(rng.randint(6, 11))), rng.choice((700, 130, 30))
        for _ in range(5):
            words[w] = words.get(w, 0) + n
            at, c = rng.randint(0, len(w) - 1), rng.choice(letters)
            w = rng.choice((w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]))
            n = max(5, n // rng.choice((1, 5, 6)))
    words |= {"aaaaaa": 40, "aaaaaaa": 7, "aaaaaaaa": 200, "aaaaab": 5, "short": 99, "rarely": 4}
    runs = [w if rng.random() < 0.8 else w.title() for w, n in words.items() for _ in range(n)]
    rng.shuffle(runs)
    return [(k if k % 9 else None, rng.choice((" ", "\n", "1", "×-")[:3]).join(runs[k * 40 : k * 40 + 40])) for k in range(len(runs) // 40 + 1)]


@pytest.mark.parametrize("seed,rows,letters", [(1, 1 << 16, 1 << 22), (2, 3, 1 << 22), (3, 1, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, rows, letters):
    monkeypatch.setattr(spelling, "ROWS", rows)
    monkeypatch.setattr(spelling, "LETTERS", letters)
    docs = corpus(seed)
    want = brute(docs)
    assert sum("None, '" not in w for w in want) > 20
    assert found(spark, docs) == want


def test_hard_rows(spark, awkward, nothing):
    long = "ab" * 3000
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    rows += [(30 + k, f"{long} {long[:99]}x{long[100:]} {long}y wörter wörtèr WÖRTER x×y÷zzz") for k in range(6)]
    assert found(spark, rows) == brute(rows)
    assert spelling.spelling_variants(nothing).collect() == []


def test_wavelet_tree_reports_every_point():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        left, low = rng.integers(0, n + 1, (2, 50))
        right, high = np.minimum(n, left + rng.integers(0, n + 1, 50)), np.minimum(n, low + rng.integers(0, n + 1, 50))
        query, value = tree.report(left, right, low, high)
        got = sorted(zip(query.tolist(), value.tolist()))
        assert got == sorted((q, v) for q in range(50) for v in values[left[q] : right[q]].tolist() if low[q] <= v < high[q])
