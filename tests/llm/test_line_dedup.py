from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from sloscope.llm import line_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, s, n):
    out = list(s)
    for _ in range(n):
        at = rng.randint(0, len(out) - 1)
        rng.choice((lambda: out.insert(at, rng.choice("abé ")), lambda: out.pop(at), lambda: out.__setitem__(at, rng.choice("abé "))))()
    return "".join(out)


def brute(rows):
    """Per row: n_lines, removed places. Earlier: by doc_id (null last), then row, then place."""
    lines = [((i is None, i or 0, k, p), x) for k, (i, t) in enumerate(rows) if t is not None for p, x in enumerate(t.split("\n"))]
    lines = sorted((place, x) for place, x in lines if x.strip(" \t\n\x0b\x0c\r"))
    gone = [[] for _ in rows]
    for k, (place, x) in enumerate(lines):
        near = lambda y: min(len(x), len(y)) >= line_dedup.LEAST and abs(len(x) - len(y)) <= line_dedup.EDITS and edits(x, y) <= line_dedup.EDITS
        if any(x == y or near(y) for _, y in lines[:k]):
            gone[place[2]].append(place[3])
    return [(i, 0 if t is None else t.count("\n") + 1, sorted(g)) for (i, t), g in zip(rows, gone)]


def cases(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefé  日") for _ in range(rng.randint(17, 60))) for _ in range(12)]
    base += ["x" * 20, "x" * 40, "short", "", " \t", "0123456789012345678"]
    rows = []
    for k in range(40):
        lines = [changed(rng, b, rng.choice((0, 0, 1, 2, 3))) if len(b) > 8 else b for b in rng.sample(base, rng.randint(0, 5))]
        rows.append((k if rng.random() > 0.1 else None, "\n".join(lines)))
    return [*rows, (3, rows[3][1]), (90, None), (91, "")]


@pytest.mark.parametrize("seed,bucket", [(1, 1000), (2, 1), (3, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    rows = cases(seed)
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, removed int").coalesce(1)
    numbered = line_dedup._numbered(docs)
    got = line_dedup.removed_lines(numbered).orderBy("rid").collect()
    want = brute(rows)
    assert [(r["doc_id"], r["n_lines"], r["removed"]) for r in got] == want
    assert [r["n_removed"] for r in got] == [len(g) for *_, g in want]
    left = {r["removed"]: r["text"] for r in line_dedup.drop_lines(docs).collect()}
    for k, ((_, t), (_, _, gone)) in enumerate(zip(rows, want)):
        assert left[k] == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone))


def test_banded_distance(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(4, 30)))
        b = changed(rng, a, rng.randint(0, 4)) or a
        pairs.append((max(a, b, key=len), min(b, a, key=len)))
    df = spark.createDataFrame([(a, b) for a, b in pairs if len(a) - len(b) <= 2 and len(b) > 2], "a string, b string")
    got = df.selectExpr("a", "b", f"{line_dedup.banded_distance('split(a, \"\")', 'split(b, \"\")')} AS d").collect()
    for r in got:
        d = edits(r["a"], r["b"])
        assert r["d"] == d if d <= 2 else r["d"] > 2


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = line_dedup.removed_lines(line_dedup._numbered(awkward)).collect()
    assert sorted((repr((r["doc_id"], r["n_lines"])) for r in got)) == sorted(repr((i, n)) for i, n, _ in brute(rows))
    assert sum(r["n_removed"] for r in got) == sum(len(g) for *_, g in brute(rows))
    assert line_dedup.removed_lines(line_dedup._numbered(nothing)).collect() == []
    assert line_dedup.drop_lines(nothing).collect() == []


def test_shuffled_keys_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in cases(5)], "doc_id long, text string").coalesce(1)
    run = lambda: sorted(map(repr, line_dedup.removed_lines(line_dedup._numbered(docs)).collect()))
    want = run()
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", -1)
    assert run() == want


@pytest.mark.parametrize("n", [3, 4, 5, 20, 61])
def test_segments_cover_a_line(spark, n):
    measured = spark.range(1).selectExpr(f"{n} AS n").select("n", *line_dedup.measures())
    for less in range(3):
        cuts = measured.selectExpr(*[f"{x} AS c{k}{j}" for k, pair in enumerate(line_dedup.segments(less)) for j, x in enumerate(pair)]).first()
        at, length = 0, n - less
        for start, size in zip(cuts[::2], cuts[1::2]):
            assert start == at and size in (length // 3, length // 3 + 1)
            at += size
        assert at == length


def common_start(n):
    rng = random.Random(n)
    lines = ["the same thirty characters at " + "".join(rng.choice("abcdefghij 0123456789") for _ in range(30)) for _ in range(n)]
    return lines + [x[:-1] + "#" for x in lines[:50]]


def test_a_hot_key_takes_time_in_proportion(spark):
    """Lines with one common start: the shared segment's key is cut by what follows it, so four times the lines don't take sixteen times as long."""
    took = {}
    for n in (1000, 1000, 4000):  # the first run compiles
        lines = common_start(n)
        docs = spark.createDataFrame([(k, "\n".join(lines[k * 50 : k * 50 + 50])) for k in range(len(lines) // 50 + 1)], "doc_id long, text string")
        began = time.perf_counter()
        got = line_dedup.removed_lines(line_dedup._numbered(docs)).collect()
        took[n] = time.perf_counter() - began
        assert sum(r["n_removed"] for r in got) == sum(r["n_near"] for r in got) == 50
    assert took[4000] < 5 * took[1000]


def test_cut_keys_are_few_lines_each(spark, monkeypatch):
    """However often short rests, common middles and periodic lines repeat, no pair in reach is lost."""
    monkeypatch.setattr(line_dedup, "BUCKET", 3)
    rng = random.Random(7)
    rows = [(k, "\n".join("".join(rng.choice(("ab", "ba", "c"))  for _ in range(11)) + rng.choice(("", "x", "same end of all")) for _ in range(3))) for k in range(25)]
    rows += [(40 + k, f"{rng.randint(0, 99):02d} a common middle of lines {rng.randint(0, 99):02d}") for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = line_dedup.removed_lines(line_dedup._numbered(docs)).orderBy("rid").collect()
    assert [(r["doc_id"], r["n_lines"], r["removed"]) for r in got] == brute(rows)


def test_deletions_meet_within_two_edits(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 10)))
        pairs.append((a, changed(rng, a, rng.randint(0, min(3, len(a) - 1))) if a else rng.choice("abc")))
    df = spark.createDataFrame(pairs, "a string, b string")
    left = lambda c: df.withColumn("line", F.col(c)).select("a", "b", line_dedup.deletions().alias("d"))
    met = {(x["a"], x["b"]) for x, y in zip(left("a").collect(), left("b").collect()) if set(x["d"]) & set(y["d"])}
    assert all((a, b) in met for a, b in pairs if edits(a, b) <= 2)
