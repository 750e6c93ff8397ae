from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash

from sloscope.llm import components, simhash


def plain_fingerprint(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable over links of three bits or fewer; ids None sort out."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_matches_brute_force(awkward):
    got = simhash.simhash_components(awkward).collect()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = {r: min((i for (i, _), s in zip(rows, roots) if s == r and i is not None), default=None) for r in roots}
    want = [(i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots)]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got)


def near(rng, center, bits):
    for b in rng.sample(range(64), bits):
        center ^= 1 << b
    return center


def edges_of(spark, prints):
    signed = np.array(sorted(set(prints)), np.uint64).view(np.int64).tolist()
    found = components.connected_components(simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")))
    return {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in found.collect()}


def check(spark, prints):
    prints = sorted(set(prints))
    root = edges_of(spark, prints)
    want = plain_components(prints)
    groups = {}
    for p, r in zip(prints, want):
        groups.setdefault(r, set()).add(p)
    got = {}
    for p in prints:
        got.setdefault(root.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_all_links_are_found(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for c in prints[:20]:
        prints += [near(rng, c, rng.randint(1, 4)) for _ in range(6)]
    check(spark, prints)


def dense(rng):
    center = rng.getrandbits(64)
    return sorted({near(rng, center, rng.randint(0, 6)) for _ in range(500)} | {rng.getrandbits(64) for _ in range(50)})


def test_large_buckets_are_cut(spark, monkeypatch):
    """A dense cluster; with small buckets in this process, so that large ones are routed by counts and cut again."""
    prints = dense(random.Random(6))
    check(spark, prints)
    monkeypatch.setattr(simhash, "BUCKET", 50)
    check(spark, prints)
    monkeypatch.setattr(simhash, "HOT_VALUES", -1)
    check(spark, prints)


def test_large_buckets_of_unlisted_keys_go_on(monkeypatch):
    """Tasks that meet a large bucket in their sorted rows pass it on whole, over any batch borders."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    prints = dense(random.Random(6))
    none, edges = np.zeros(0, np.uint64), []
    fp = pa.array(np.array(prints, np.uint64).view(np.int64))
    batch = pa.RecordBatch.from_arrays([fp, fp], names=["fp", "root"])
    level = [b for wild in (False, True) for b in simhash._variants([batch], wild, none, False)]
    for _ in range(6):
        rows = pa.Table.from_batches(level).sort_by("key")
        out = pa.Table.from_batches(simhash._links(rows.to_batches(max_chunksize=37)))
        table = out.to_pandas()
        edges += table[~table.hot][["fp", "root"]].itertuples(index=False)
        hot = out.filter(out["hot"]).drop_columns(["hot"])
        if not len(hot):
            break
        level = list(simhash._cut(hot.to_batches()))
    assert not len(hot)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        a, b = int(a) & (2**64 - 1), int(b) & (2**64 - 1)
        root[find(a)] = find(b)
    want = plain_components(prints)
    assert len({find(p) for p in prints}) == len(set(want))


def test_forest_joins_known_components_only():
    fp = np.array([0, 1, 0b1111, 0xFF00, 0xFF01, 0xFFFF << 40], np.uint64)
    roots = np.array([7, 7, 7, 9, 9, 3], np.uint64)
    assert [len(x) for x in simhash._forest(fp, roots)] == [0, 0]
    a, b = simhash._forest(fp, np.array([7, 8, 8, 9, 9, 3], np.uint64))
    assert {*a.tolist(), *b.tolist()} <= {0, 1, 0b1111} and len(a) == 1


def test_empty_table_and_stage(nothing, awkward):
    assert simhash.simhash_components(nothing).collect() == []
    assert simhash.keep_heads(nothing, 5).collect() == []
    kept = simhash.keep_heads(awkward, 5)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 10, 2, 7, 8, 9]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components.connected_components(edges.limit(0)).collect() == []
