from __future__ import annotations

import random
import re
from itertools import permutations

from sloscope.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, part string, th long"


def brute(rows, labels):
    """Every filter applied to every document in every order, one after another."""
    texts = [(i, t or "", s or "") for i, t, s in rows]
    key = lambda i: (i is None, i or 0)

    def failed(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)}
        return found | {"D": any(c in "#$%&*|" for c in t), "E": any(u == t and key(j) < key(i) for j, u, _ in texts)}

    judged = [(i, s, failed(i, t)) for i, t, s in texts]
    good, toxic = ({i for i, *flags in labels if flags[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {s for _, s, _ in judged}:
        own = [(i, f) for i, s, f in judged if s == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                total[x] += len(gone)
                alone = sum(f[x] and sum(f.values()) == 1 for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f[x] for _, f in own) - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x]
        for (p, *_), row in out.items():
            if p == part:
                row[-1] = total[row[-1]]
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 7, "p", k) for k, r in enumerate(rows)], SCHEMA)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == brute(rows, labels)
    assert len(got) == 600 * len({s or "" for *_, s in rows})


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        n = rng.choice((0, 1, 30, 199, 200, 260))
        words = [f"w{rng.randint(0, rng.choice((20, 400)))}" for _ in range(n)]
        if rng.random() < 0.3:
            words += [rng.choice(("A & B", "#tag", "50%", "UPPER" * 20))]
        rows.append((k, rng.choice(" \n\t\x0b").join(words), rng.choice(("web", "books", None, ""))))
    rows += [(200 + k, rows[k][1], "web") for k in range(15)] + [(5, rows[5][1], "books")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 130, 2)] + [(4, 1, 1), (None, 1, 1)]
    check(spark, rows, labels)


def test_hard_rows(spark):
    long = "Word " * 50_000
    rows = [(1, None, None), (2, "", ""), (None, "", "x"), (None, None, "x"), (3, " \r\n", "x"), (4, "é ü ß" * 300, "x"), (5, long, "x"), (6, long, "y"), (6, long, "y"), (7, "A", "x"), (8, "|", "z")]
    check(spark, rows, [(1, 1, 0), (6, 1, 1)])
    check(spark, rows[:1], [])


def test_exact_borders(spark):
    distinct = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(distinct[:199]), "s"), (2, " ".join(distinct), "s"), (3, " ".join(distinct[:100] * 2), "s"), (4, " ".join(distinct[:99] * 2 + ["w0", "w1"]), "s")]
    rows += [(5, "A" + "b" * 49, "s"), (6, "AA" + "b" * 48, "s"), (7, "A" + "b" * 48, "s")]
    check(spark, rows, [])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
