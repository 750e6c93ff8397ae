from __future__ import annotations

import random
from collections import Counter

from sloscope.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside))
    return (*counts, len(words) < 50 or 100 * len(inside) > 50 * len(words))


def made(rng, good):
    words = [rng.choice(("river", "stone", "cloud", "meadow", "über", "née", "winter", "light")) + rng.choice("abcdefgh") for _ in range(120)]
    return " ".join(words) if good else " ".join(w + rng.choice(("$$$", "&&&", "***")) for w in words)


def fixture(spark):
    rng = random.Random(3)
    docs = [(k, made(rng, k % 3 > 0)) for k in range(300)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(240)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts_match_brute_force(awkward):
    rows = quality.score_documents(awkward, None)
    got = [tuple(r[c] for c in (*quality.COUNTS, "base_failed")) for r in rows.collect()]
    assert sorted(got) == sorted(brute(r["text"]) for r in awkward.collect())
    assert rows.filter("kept = base_failed").count() == 0
    assert rows.select("row.*").columns == awkward.columns


def test_counts_on_random_texts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab c\n\t#|é") for _ in range(rng.randint(0, 120)))
        assert quality.judge(text, None)[:6] == brute(text)


def test_held_out_accuracy(spark):
    docs, labels = fixture(spark)
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {k for k in range(300) if k % 3 > 0}


def test_same_model_for_any_partitioning(spark):
    docs, labels = fixture(spark)
    a, b = (quality.train(docs.repartition(n), labels.repartition(8 - n), sample=100) for n in (1, 7))
    assert (a.weights == b.weights).all() and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


def test_without_labels_the_rules_decide(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1), (3, 7, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(awkward, labels) is None
    assert quality.train(nothing, labels.limit(0)) is None
    kept = quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and kept.collect() == []
    assert quality.keep_good(nothing, labels).collect() == []


def test_op4(corpus, spark):
    docs, labels = fixture(spark)
    rows = quality.op4_quality_rules(spark, corpus(documents=docs, labels=labels)).collect()
    assert len(rows) == 300 and sum(r["kept"] for r in rows) == 200
    assert all((r["probability"] >= 0.5) == r["kept"] for r in rows if not r["base_failed"])
