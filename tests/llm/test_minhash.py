from __future__ import annotations

import random

import numpy as np
import pytest

from sloscope.llm import minhash


def brute(rows, near=85):
    """doc_id, n_shingles, component_id, kept by comparing every pair of sets."""
    sets = []
    for _, t in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
        words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        sets.append({" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= near * len(sets[x] | sets[y]):
                old, new = label[x], label[y]
                label = [new if v == old else v for v in label]
    key = lambda i: (i is None, i or 0)
    out = []
    for k, (i, _) in enumerate(rows):
        head = min((rows[j][0] for j in range(len(rows)) if label[j] == label[k]), key=key)
        out.append((i, len(sets[k]), head, i == head))
    return sorted(map(repr, out))


def found(spark, rows, near=85):
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node string, n int")
    return sorted(repr(tuple(r)) for r in minhash.near_components(docs, near).collect())


def families(seed, count=14, copies=7):
    """Texts with word changes at many rates, so that similarities stand on both sides of the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice((3, 8, 40, 150, 400)))]
        for _ in range(copies):
            own = [f"z{rng.randint(0, 999)}" if rng.random() < rng.choice((0, 0.005, 0.01, 0.02, 0.03)) else w for w in base]
            rows.append((len(rows), rng.choice((" ", "\n", "  ")).join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,bucket,rounds", [(1, 5000, 3), (2, 1, 0), (3, 2, 1)])
def test_components_match_brute_force(spark, monkeypatch, seed, bucket, rounds):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    rows = families(seed)
    assert found(spark, rows) == brute(rows)


def test_dense_group_below_the_threshold_stays_apart(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET", 4)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(f"q{k}x{j}" if j in at else w for j, w in enumerate(base))) for k in range(40) for at in [set(rng.sample(range(0, 300, 6), 6))]]
    rows += [(100, rows[0][1] + " tail"), (None, rows[3][1]), (101, " ".join(base))]
    assert found(spark, rows) == brute(rows)


def test_hard_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    rows += [(20, "long " + "word " * 3 + " ".join(f"u{k}" for k in range(90_000))), (21, " ".join(f"u{k}" for k in range(90_000)))]
    assert found(spark, rows) == brute(rows)
    assert minhash.near_components(nothing).collect() == []


def definition(own):
    """SuperMinHash one element and place after another."""
    least = [2**64 - 1] * minhash.PLACES
    for x in own.tolist():
        perm = list(range(minhash.PLACES))
        for j in range(minhash.PLACES):
            z = int(minhash._mixed(np.array([x + (2 * j + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1], np.uint64))[0])
            draw = int(minhash._mixed(np.array([z ^ minhash.SEED], np.uint64))[0]) >> 64 - minhash._DRAW
            k = j + ((z >> 32) * (minhash.PLACES - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            least[perm[j]] = min(least[perm[j]], j << minhash._DRAW | draw)
    return least


def test_signature_is_the_definitions(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (1, 2, 5, 60, 0, 300)]
    want = [definition(s) for s in sets]
    assert minhash.signatures(sets).tolist() == want
    monkeypatch.setattr(minhash, "_PART", 16)
    assert minhash.signatures(sets).tolist() == want


def test_estimate_is_unbiased_and_below_the_variance_of_minima():
    rng = np.random.default_rng(5)
    shares = []
    for _ in range(300):
        x = rng.integers(0, 2**64, 40, np.uint64)
        a, b = minhash.signatures([x[:30], x[10:]])
        shares.append((a == b).mean())
    plain = 0.5 * 0.5 / minhash.PLACES
    assert abs(np.mean(shares) - 0.5) < 4 * (plain / 300) ** 0.5
    assert np.var(shares) < 0.8 * plain


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(6)
    for n in (1, 40, 300, 5000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate((a[n // 7 :], rng.integers(0, 2**64, n // 9, np.uint64))))
        odd = int(np.bitwise_count(minhash.parities(a) ^ minhash.parities(b)).sum())
        apart = len(np.setxor1d(a, b))
        assert odd <= apart and (apart - odd) % 2 == 0
        assert n > 300 or odd >= apart * 0.7
