from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sloscope.llm import deepsort, suffix_dedup


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 50), st.text("ab", max_size=8)), max_size=60))
def test_deep_shallow_orders_and_measures(parts):
    strings = [b"a" * n + t.encode() for _, n, t in parts]
    group = np.array([g for g, _, _ in parts], np.int64)
    order, lcp = deepsort.deep_shallow(strings, group)
    got = [(int(group[k]), strings[k]) for k in order]
    assert got == sorted((g, s) for g, s in zip(group.tolist(), strings))
    for k in range(len(got)):
        if k == 0 or got[k][0] != got[k - 1][0]:
            assert lcp[k] == -1
        else:
            a, b = got[k - 1][1], got[k][1]
            want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([b"", b"ab" * 40, b"abc" * 30, b"q" * 70]), st.one_of(st.sampled_from([b"", b"a", b"ab", b"abcdefgh"]), st.binary(max_size=12))), min_size=13, max_size=120))
def test_multikey_quicksort_splits_many_strings(parts):
    strings = [a + b for a, b in parts * 2]
    order, lcp = deepsort.multikey_quicksort(strings, list(range(len(strings))))
    assert [strings[k] for k in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    assert lcp == [deepsort.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def brute(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "délta", "of", "the", "x", "日本", "zeta\n"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(("", "s", "ing", str(rng.randint(0, 99)))) for _ in range(n))
    passages = [text(rng.randint(60, 400)) for _ in range(5)]
    rows = []
    for k in range(60):
        parts = [text(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(300, 2500)], text(rng.randint(0, 100))]
        rows.append((k, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (None, rows[5][1]), (None, None), (102, ""), (103, "a" * 1500), (104, "ab" * 350), (105, "b" * 400), (106, "a" * 399)]
    rows += [(107, passages[0] * 3), (108, "".join(rng.choice("xyz") for _ in range(3000))), (109, rows[-1][1][5:800])]
    return rows


@pytest.mark.parametrize("seed,group,piece", [(1, 20_000, 200_000), (2, 1, 200_000), (3, 6, 700)])
def test_matches_brute_force(spark, corpus, monkeypatch, seed, group, piece):
    """With groups cut at every level and small pieces, too: the same bytes."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = cases(seed)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    check_pieces(rows, piece)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.op3_suffix_dedup(spark, corpus(documents=docs)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert sorted(((r["doc_id"], r["n_repeated"]) for r in got), key=str) == sorted(((i, n) for i, _, n, *_ in brute(rows, 250)), key=str)
    whole = {i: t or "" for i, t in rows}
    assert all(r["text"] == whole[r["doc_id"]] for r in got if not r["n_removed"] and r["doc_id"] is not None)
    assert all(len(r["text"].encode()) <= r["n_bytes"] - r["n_removed"] for r in got)


def check_pieces(rows, piece):
    """Anchors of documents cut into pieces are those of whole ones: same windows, same offsets, contexts of up to 400 bytes."""
    import pyarrow as pa

    data = [(t or "").encode() for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int64()), pa.array(range(len(data)), pa.int64()), pa.array(data, pa.binary())], names=[*suffix_dedup.ROW, "bytes"])

    def windows(piece):
        out = {}
        for b in suffix_dedup._anchor_rows([batch], piece, 400, 250):
            for r in b.to_pylist():
                back, more, size = r["shape"] & 0xFFFFF, r["shape"] >> 20 & 0xFFFFF, r["shape"] >> 40
                assert size == min(more + 400, len(data[r["_rh"]]) - r["low"])
                for k in range(more + 1):
                    assert (r["_rh"], r["low"] + k) not in out
                    out[r["_rh"], r["low"] + k] = (r["low"] + back, r["gram"])
        return out

    want = windows(200_000)
    assert windows(piece) == want
    assert len(want) == sum(max(0, len(d) - 249) for d in data)


def test_awkward_rows_and_no_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = suffix_dedup.suffix_dedup(awkward).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got), key=str) == brute(rows)
    assert suffix_dedup.suffix_dedup(nothing).collect() == []


@pytest.mark.parametrize("group", [20_000, 1])
def test_repeats_over_piece_borders(spark, monkeypatch, group):
    """Pieces are small in the workers, too: windows on both sides of a piece's end count."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for k in range(40):
        long = noise(4000)
        start = 1000 * rng.randint(1, 2) - rng.randint(0, 700)
        rows += [(2 * k, long), (2 * k + 1, noise(50) + long[start : start + rng.randint(400, 800)] + noise(50))]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    done = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got]
    assert sorted(done, key=str) == brute(rows)
