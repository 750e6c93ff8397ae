from __future__ import annotations

import base64
import hashlib
import random
import struct
import time
import zlib
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sloscope.llm import bpe, packing

LINES = [line.split() for line in open(P.path(bpe.RANKS), "rb")]
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in LINES}, special_tokens={})
HF = Tokenizer.from_file(P.path(packing.TOKENIZER))


def unpack(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_both_codecs_agree_with_the_libraries(text):
    encoder, pieces = bpe.codec(bpe.RANKS)
    (ids,) = pieces.encode([text])
    assert unpack(ids) == TIK.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()
    assert unpack(packing.token_ids(text)) == HF.encode(text, add_special_tokens=False).ids


def test_long_pieces_and_small_memo():
    encoder, pieces = bpe.codec(bpe.RANKS)
    for text in ("a" * 5000, "<|endoftext|>" * 50, "é" * 999, " \n" * 700, "x!" * 3 + "€" * 1025, "ab" * 8 + "c"):
        (ids,) = pieces.encode([text])
        assert unpack(ids) == TIK.encode_ordinary(text)
    small = bpe.PieceCodec(lambda new: encoder.encode_pieces([p.encode() for p in new]), limit=2)
    for text in ("The theory of this", "and of that theory"):
        assert unpack(small.encode([text])[0]) == TIK.encode_ordinary(text)


def test_every_kind_of_character():
    encoder, pieces = bpe.codec(bpe.RANKS)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1 <|endoftext|>" for c in [*range(0x3100), *range(0x1F300, 0x1F700)] if not 0xD800 <= c <= 0xDFFF]
    for text, ids, hf in zip(texts, pieces.encode(texts), HF.encode_batch(texts, add_special_tokens=False)):
        assert TIK.encode_ordinary(text) == unpack(ids)
        assert hf.ids == unpack(packing.token_ids(text))


END = "<|endoftext|>"


@pytest.mark.parametrize("text", [END, f"{END}a b", f"a b{END}", f"a {END} b", f"a{END}b", END * 3, f"a  {END}  {END}\n\nb", f"{END[:-1]} {END}{END[1:]}", f"<|{END}|>", "x" + END + "é" * 9 + END])
def test_added_tokens_in_a_text_are_one_id(text):
    want = HF.encode(text, add_special_tokens=False).ids
    assert unpack(packing.token_ids(text)) == want and 50256 in want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(END), st.sampled_from(["<|", "|>", "endoftext", " ", "\n", "a", "'s", "12"]), st.text(max_size=4)), max_size=12))
def test_added_tokens_among_other_text(parts):
    text = "".join(parts)
    assert unpack(packing.token_ids(text)) == HF.encode(text, add_special_tokens=False).ids

def test_encode_documents(awkward, nothing):
    got = bpe.encode_documents(awkward).collect()
    want = [(r["doc_id"], TIK.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in awkward.collect()]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], unpack(r["ids"]), bytes(r["decoded"]))) for r in got)
    assert bpe.encode_documents(nothing).collect() == []


def test_op9_digests(corpus, awkward, spark):
    got = bpe.op9_byte_bpe(spark, corpus(documents=awkward)).collect()
    want = []
    for r in awkward.collect():
        ids = TIK.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def check_packing(rows, docs, window=1024):
    """Pieces cover each document once, offsets have no gaps, padding is nowhere but in the last window."""
    by_window = defaultdict(list)
    for r in rows:
        by_window[r["sequence_id"]].append(r)
    for held in by_window.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == [sum(x["length"] for x in held[:k]) for k in range(len(held))]
        fill = sum(r["length"] for r in held)
        assert fill <= window and fill & (fill - 1) == 0
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["crc"], r["doc_tokens"]))
    for i, texts in docs.items():
        want = []
        for ids in ([*HF.encode(t, add_special_tokens=False).ids, 0] for t in texts):
            want.append(ids)
        got = sorted(pieces.pop(i))
        assert sum(n for _, n, _, _ in got) == sum(map(len, want))
        if len(want) == 1:
            assert all(t == len(want[0]) for *_, t in got)
            at = 0
            for start, n, crc, _ in got:
                assert start == at
                assert crc == zlib.crc32(struct.pack(f"<{n}I", *want[0][start : start + n]))
                at += n
    assert not pieces


def test_op8_packing(corpus, awkward, spark, nothing):
    docs = defaultdict(list)
    for r in awkward.collect():
        docs[r["doc_id"]].append(r["text"] or "")
    rows = packing.op8_packing(spark, corpus(documents=awkward)).withColumnRenamed("ids_crc32", "crc").collect()
    check_packing(rows, docs)
    assert packing.pack_documents(nothing).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=120))
def test_packer_loses_and_pads_nothing(sizes):
    packer = packing.SumOfSquaresPacker(32)
    windows = []
    for tag, n in enumerate(sizes):
        windows += packer.add(tag, struct.pack(f"<{n}I", *range(n)))
    windows += packer.close()
    seen = defaultdict(list)
    for held in windows:
        fill = sum(len(ids) // 4 for *_, ids in held)
        assert fill <= 32 and fill & (fill - 1) == 0
        for tag, start, ids in held:
            assert unpack(ids) == list(range(start, start + len(ids) // 4))
            seen[tag] += unpack(ids)
    assert {t: sorted(x) for t, x in seen.items()} == {t: list(range(n)) for t, n in enumerate(sizes)}


def test_level_choice_keeps_the_sum_of_squares_least():
    packer = packing.SumOfSquaresPacker(10)
    packer.counts[[3, 6]] = 2, 1
    packer.open[3], packer.open[6] = [[("a", 0, bytes(12))]] * 2, [[("b", 0, bytes(24))]]

    def total_after(level, size):
        counts = packer.counts.copy()
        if level:
            counts[level] -= 1
        if level + size < 10:
            counts[level + size] += 1
        return int((counts**2).sum())

    for size in range(1, 11):
        legal = [level for level in range(11 - size) if not level or packer.counts[level]]
        assert total_after(packer._place(size), size) == min(total_after(level, size) for level in legal)


@pytest.mark.parametrize("alphabet", ["ab", "a", "etaoinshrdlu", "é日ab", "xy z\n"])
def test_long_pieces_are_encoded_as_short_ones(alphabet, monkeypatch):
    """Around the length at which a piece's tree is walked alone, both ways give the same ids."""
    encoder, _ = bpe.codec(bpe.RANKS)
    rng = random.Random(len(alphabet))
    pieces = ["".join(rng.choice(alphabet) for _ in range(n)).encode() for n in (1023, 1024, 1025, 1500, 2500)]
    alone = encoder.encode_pieces(pieces)
    monkeypatch.setattr(bpe, "LONG", 1 << 30)
    assert encoder.encode_pieces(pieces) == alone
    assert [encoder.decode(a) for a in alone] == pieces


def test_a_very_long_piece_takes_time_in_proportion():
    encoder, _ = bpe.codec(bpe.RANKS)
    rng = random.Random(1)
    piece = "".join(rng.choice("etaoinshrdlucmw") for _ in range(300_000)).encode()
    began = time.perf_counter()
    assert encoder.decode(encoder.encode_pieces([piece])[0]) == piece
    assert time.perf_counter() - began < 30
