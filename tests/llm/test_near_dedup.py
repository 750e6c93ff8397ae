from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sloscope.llm import minhash, near_dedup, simhash

WORDS = [f"{a}{b}" for a in ("river", "stone", "cloud", "née") for b in "abcdefghij"]


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Ids that stay: the least of each component of pairs at 0.8 or more."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(rows[k][0] for k in {find(k) for k in range(len(rows))})


def corpus_rows():
    rng = random.Random(4)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    common, texts = prose(60), []
    for _ in range(25):
        words = prose(rng.randint(50, 300))
        texts.append(words)
        for edits in (1, 3, 5, 7, 10, 14):
            near = list(words)
            for at in rng.sample(range(len(near)), edits):
                near[at] = rng.choice(("changed", near[at] + "x"))
            texts.append(near[rng.choice((0, 0, 9)) :] + common * rng.choice((0, 0, 1)))
    texts += [common + prose(4) for _ in range(30)]  # one group of near copies
    texts = [" ".join(t) for t in texts] + ["", None, "One two", "one\ntwo", "one two three"]
    return list(enumerate(texts))


def test_pairs_at_the_threshold_and_above_are_joined(spark):
    rows = corpus_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("bucket", [2, 100])
def test_bands_with_many_members_are_cut(spark, monkeypatch, bucket):
    """Without rounds and with tiny buckets all links come from cut bands and the pairs left in them."""
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    rows = corpus_rows()
    got = near_dedup.keep_heads(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == brute(rows)


def test_a_dense_group_gives_few_pairs(spark):
    """Copies with a change each: what is verified grows with the group, not with its square."""
    rng = random.Random(2)
    base = [rng.choice(WORDS) + str(k) for k in range(200)]
    rows = []
    for k in range(300):
        words = list(base)
        words[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    links = minhash._links
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(minhash, "_links", lambda pairs, own, near: seen.append(pairs.distinct().count()) or links(pairs, own, near))
        assert [r["doc_id"] for r in near_dedup.keep_heads(docs).collect()] == [0]
    assert sum(seen) < 20 * 300


def test_fingerprints_within_three_bits_are_met_and_verified(spark, monkeypatch):
    """With the bands shut, SimHash alone joins what it links, but only what is similar."""
    monkeypatch.setattr(minhash, "_may_match", lambda *_: F.lit(False))
    rng = random.Random(9)
    texts = []
    for k in range(12):
        words = [f"{rng.choice(WORDS)}{rng.randrange(500)}" for _ in range(1500)]
        texts.append(" ".join(words))
        for _ in range(3):
            words[rng.randrange(1500)] = "changed"
            texts.append(" ".join(words))
    common = "one two three " * 400
    alike = len(texts)  # one repeated phrase decides the fingerprints of texts that are not similar
    texts += [common + " ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(3)]
    prints, sets, root = [simhash.fingerprint(t) for t in texts], [plain_shingles(t) for t in texts], list(range(len(texts)))
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    assert near(alike, alike + 1) and near(alike, alike + 2)
    for a in range(len(texts)):
        for b in range(a):
            if near(a, b) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    got = corpus_pipeline.near(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root)) and len(set(root)) < 30


@pytest.mark.parametrize("near", [0.80, 0.85])
def test_no_link_at_the_threshold_is_lost(near):
    """Of 400 pairs just at the threshold all share three bands, as cut bands need, and agree in enough places."""
    rng = np.random.default_rng(3)
    shared, alike = [], []
    for _ in range(400):
        n = int(rng.integers(20, 400))
        both = -(-int(near * 100) * n // 100)
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.concatenate((a[:both], rng.integers(0, 2**64, (n - both) // 2, np.uint64)))  # the union is larger by a half of the rest
        a = np.concatenate((a[:both], a[both:][: n - both - (n - both) // 2]))
        assert minhash.similar(np.unique(a), np.unique(b), int(near * 100))
        one, other = minhash.signatures([a, b])
        shared.append((one == other).reshape(minhash.BANDS, minhash.DEPTH).all(axis=1).sum())
        alike.append((one == other).sum())
    assert min(shared) > minhash.CUTS and min(alike) >= minhash.least_alike(int(near * 100))
