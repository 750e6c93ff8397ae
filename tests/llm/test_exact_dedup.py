from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sloscope.llm import exact_dedup, fuse


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300))
def test_filter_has_no_false_negative(keys):
    keys = np.array(keys, np.uint64)
    assert fuse.contains(fuse.build(keys), keys).all()


def test_filter_false_positive_rate():
    keys, other = np.random.default_rng(1).integers(0, 2**63, (2, 50_000)).astype(np.uint64)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    assert fuse.contains(blob, other).mean() < 0.01
    assert len(blob) < 1.3 * len(keys)


def brute(rows):
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), n in zip(rows, norm):
        groups[n].append(i)
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [x for x in groups[n] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split_at", [None, -1, 4, 100])
def test_matches_brute_force(awkward, split_at):
    got = exact_dedup.exact_dedup(awkward, split_at).collect()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert len({r["text_sha256"] for r in kept}) == len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_salted_join_gives_the_same(awkward, monkeypatch):
    want = sorted(map(repr, exact_dedup.exact_dedup(awkward).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", 0)
    assert sorted(map(repr, exact_dedup.exact_dedup(awkward).collect())) == want


def test_empty_table(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []
    assert exact_dedup.keep_first(nothing).collect() == []


def test_keep_first_returns_whole_rows(awkward):
    kept = exact_dedup.keep_first(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in awkward.collect()})
    assert [r["doc_id"] for r in rows if (r["text"] or "") == ""] in ([2], [3])


def test_hot_group(spark):
    rows = spark.range(600).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    got = exact_dedup.exact_dedup(rows)
    assert got.filter("keep_id = 0 and group_size = 200").count() == 200
    assert got.filter("kept").count() == 401
