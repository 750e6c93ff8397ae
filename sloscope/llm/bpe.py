"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece's leaves hold the rank of the pair that begins at each live position and
its node the least of both children, ties to the left: the root is the leftmost
minimum pair. A merge changes three leaves (the pair, its right half, its left
neighbour), each a logarithmic walk to the root; live neighbours are linked lists.
Trees of many pieces of one width advance together as rows of one array; a long piece,
of which there are few, has a tree of its own.

Defined cases: a null text counts as empty and has no ids; characters that are
not valid on their own never occur in a Spark string. Repeated rows and null ids
give a row each, an empty table none.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.llm.common import table
from sloscope.llm.pieces import PieceCodec, chunks

RANKS = "byte_bpe_50k.tiktoken"
#: Leaves of the trees that advance together.
FOREST = 1 << 19
#: Bytes of a piece beyond which its tree is walked alone.
LONG = 1024
_SHIFT = np.int64(32)
_NONE = np.int64(1) << np.int64(62)


class BytePairEncoder:
    """Ranks file of lines ``base64(token) rank``; ids are the ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << _SHIFT | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; a piece that is a token is that token."""
        out: list[bytes] = [b""] * len(pieces)
        by_width = defaultdict(list)
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[k] = self._merge_long(piece)
            elif piece:
                by_width[max(2, 1 << (len(piece) - 1).bit_length())].append(k)
        for width, own in by_width.items():
            step = max(1, FOREST // width)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                for k, ids in zip(part, self._merge([pieces[k] for k in part], width)):
                    out[k] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> Iterator[bytes]:
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        stride = width + 1  # one slot more, so that the end has a neighbour
        ids = np.zeros((n, stride), np.int64)
        ids[:, :width] = self.bytes[padded]
        after = np.tile(np.arange(1, stride + 1, dtype=np.int64), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        tree = np.full((n, 2 * width), _NONE)
        place = np.arange(width - 1, dtype=np.int64)
        first = self._rank(ids[:, : width - 1], ids[:, 1:width])
        live = (first >= 0) & (place[None, :] + 1 < sizes[:, None])
        tree[:, width : 2 * width - 1] = np.where(live, first << _SHIFT | place, _NONE)
        for level in range(width.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        ids_, after_, before_, tree_ = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        levels = width.bit_length() - 1

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            base, node = row * (2 * width), leaf + width
            tree_[base + node] = value
            for _ in range(levels):
                node = node >> 1
                tree_[base + node] = np.minimum(tree_[base + 2 * node], tree_[base + 2 * node + 1])

        def fresh(row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            rank = self._rank(ids_[row * stride + left], ids_[row * stride + right])
            return np.where((rank >= 0) & (right < sizes[row]), rank << _SHIFT | left, _NONE)

        while len(rows):
            top = tree_[rows * (2 * width) + 1]
            at = top & np.int64(0xFFFFFFFF)
            base = rows * stride
            gone = after_[base + at]
            beyond = np.minimum(after_[base + gone], width)
            ids_[base + at] = top >> _SHIFT
            after_[base + at] = beyond
            before_[base + beyond] = at
            after_[base + gone] = -1
            put(rows, gone, np.full(len(rows), _NONE))
            put(rows, at, fresh(rows, at, beyond))
            left = before_[base + at]
            has = left >= 0
            put(rows[has], left[has], fresh(rows[has], left[has], at[has]))
            rows = rows[tree_[rows * (2 * width) + 1] < _NONE]
        held = (after[:, :width] >= 0) & (np.arange(width)[None, :] < sizes[:, None])
        flat = ids[:, :width][held].astype("<u4")
        ends = np.cumsum(held.sum(axis=1)).tolist()
        packed = flat.tobytes()
        return (packed[4 * a : 4 * b] for a, b in zip([0, *ends], ends))

    def _merge_long(self, piece: bytes) -> bytes:
        """The same for one piece: with no other trees beside it, plain numbers are faster than arrays of one row."""
        n, find, none = len(piece), self.pairs.get, 1 << 62
        width = 1 << (n - 1).bit_length()
        ids, before, after = self.bytes[np.frombuffer(piece, np.uint8)].tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        tree = [none] * (2 * width)
        for k in range(n - 1):
            rank = find(ids[k] << 32 | ids[k + 1])
            if rank is not None:
                tree[width + k] = rank << 32 | k
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                least = value if value < other else other
                if tree[node] == least:
                    return
                tree[node] = value = least

        while (top := tree[1]) < none:
            at = top & 0xFFFFFFFF
            gone = after[at]
            beyond, left = after[gone], before[at]
            ids[at], ids[gone] = top >> 32, -1
            after[at] = beyond
            put(gone, none)
            rank = None
            if beyond >= 0:
                before[beyond] = at
                rank = find(ids[at] << 32 | ids[beyond])
            put(at, none if rank is None else rank << 32 | at)
            if left >= 0:
                rank = find(ids[left] << 32 | ids[at])
                put(left, none if rank is None else rank << 32 | left)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_loaded: dict[str, tuple[BytePairEncoder, PieceCodec]] = {}


def codec(name: str) -> tuple[BytePairEncoder, PieceCodec]:
    """The worker's encoder and memo for a ranks file, loaded once."""
    if name not in _loaded:
        encoder = BytePairEncoder(public_tokenizers.path(name))
        _loaded[name] = encoder, PieceCodec(lambda new: encoder.encode_pieces([p.encode() for p in new]))
    return _loaded[name]


def _encode(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    encoder, pieces = codec(name)
    for batch in batches:
        rows = zip(batch.column("doc_id").to_pylist(), (t.as_py() or "" for t in batch.column("text")))
        for part in chunks(rows):
            packed = pieces.encode([t for _, t in part])
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array(packed, pa.binary()), pa.array(map(encoder.decode, packed), pa.binary())], names=["doc_id", "ids", "decoded"])


def encode_documents(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the bytes decoded from them, for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, name=ranks), "doc_id long, ids binary, decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_documents(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
