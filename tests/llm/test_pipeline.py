from __future__ import annotations

import random
import re
import struct
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sloscope.llm import packing
from tests.llm.test_near_dedup import plain_shingles
from tests.llm.test_quality import brute as plain_counts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("river", "stone", "cloud", "meadow", "winter", "light", "über", "née") for b in "abcdefghij"]
HEX = "0123456789abcdef0123456789abcdef01234567"


def prose(rng, n=120):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus_rows():
    rng = random.Random(8)
    texts = [prose(rng) for _ in range(60)]
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[1]]  # equal after white space
    texts += [texts[2] + ".", texts[3].replace(texts[3].split()[50], "changed", 1)]  # close
    texts += [" ".join(w + "$$$" for w in prose(rng).split()) for _ in range(25)]  # junk
    texts += [None, "", "too short", "word " * 200]
    texts += [f'{prose(rng)} mail a{k}@b.example.org or +1 (555) 010-99{k:02d} token = "{HEX[k:]}{HEX[:k]}"' for k in range(4)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, int("$$$" not in (t or "")), 0) for k, t in enumerate(texts) if t and len(t.split()) >= 50 and k % 4]
    return rows, labels


@pytest.fixture()
def staged(spark, corpus):
    rows, labels = corpus_rows()
    return corpus(documents=spark.createDataFrame(rows, COLUMNS), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def ids_of(text, tokenizer=Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_every_stage_against_brute_force(spark, staged, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash", "pii", "packing"]
    docs, seen = spark.read.parquet(f"{staged}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, staged)
        if k < 4:
            assert out.columns == docs.columns and [x for _, x in out.dtypes] == [x for _, x in docs.dtypes]
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append({r["doc_id"]: r for r in docs.collect()} if k < 4 else docs.collect())
    good, exact, near, clean, pieces = seen
    rows, _ = corpus_rows()
    texts = {k: t or "" for k, t, *_ in rows}

    assert set(good) == {k for k, t in texts.items() if "$$$" not in t and not plain_counts(t)[5]}
    first = {}
    for k in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[k]), k)
    assert set(exact) == set(first.values())
    left = sorted(exact)
    sets, root = {k: plain_shingles(texts[k]) for k in left}, {k: k for k in left}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in left:
        for b in left:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(near) == sorted({find(k) for k in left}) and len(near) < len(left)
    assert set(clean) == set(near)
    for k, r in clean.items():
        want = re.sub(r"a\d@b\.example\.org", "[EMAIL]", texts[k])
        want = re.sub(r"\+1 \(555\) 010-99\d\d", "[PHONE]", want)
        want = re.sub(r'"[0-9a-f]{40}"', '"[ID]"', want)
        assert r["text"] == want and r["n_chars"] == len(want) and r["source"] == f"s{k % 3}"
    by_doc = defaultdict(dict)
    for r in pieces:
        by_doc[r["doc_id"]][r["start"]] = bytes(r["ids"])
    assert set(by_doc) == set(clean)
    for k, held in by_doc.items():
        assert b"".join(held[s] for s in sorted(held)) == struct.pack(f"<{len(ids_of(clean[k]['text']))}I", *ids_of(clean[k]["text"])) + struct.pack("<I", 0)


def test_run_gives_the_last_stage(spark, staged):
    out = corpus_pipeline.run(spark, staged)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, corpus):
    folder = corpus(documents=spark.createDataFrame([], COLUMNS), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).collect() == []


CLASHES = ["_sha", "_SHA", "_did", "_th", "_tg", "_no_id", "_fp", "_order", "_row", "row", "ROW", "_q_kept", "kept", "probability", "n_words", "_pii_email", "_pii_did", "email", "id", "new", "seen", "key", "node", "root", "text2", "with.dot", "spans"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_with_clashing_names_pass_through(spark, staged, stage):
    """Columns named like those that the operators use inside come out as they went in."""
    used = [c for k, c in enumerate(CLASHES) if c.lower() not in {x.lower() for x in CLASHES[:k]}]
    docs = spark.read.parquet(f"{staged}/documents.parquet")
    extra = docs.selectExpr("*", *(f"concat(doc_id, '-{k}') AS `{c}`" for k, c in enumerate(used)))
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, extra, staged)
    assert out.columns == extra.columns
    plain = sorted((r["doc_id"], r["text"]) for r in run(spark, docs, staged).collect())
    rows = out.collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == plain
    assert all(r[c] == f"{r['doc_id']}-{k}" for r in rows for k, c in enumerate(used))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_hard_rows(spark, corpus, awkward, nothing, stage):
    """Nulls in any column, empty and long texts, repeated rows and no rows."""
    folder = corpus(labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, nothing, folder).collect() == []
    rows = run(spark, awkward, folder).collect()
    want = {"quality_rules": 0, "exact_dedup": 8, "simhash": 6, "pii": 13}.get(stage)
    assert len(rows) == want if want is not None else {r["doc_id"] for r in rows} == {r["doc_id"] for r in awkward.collect()}
