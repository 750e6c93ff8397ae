"""Sum-of-squares online packing of token sequences into windows.

A document's full windows close at once; its rest goes to the fill level for
which the sum of squared counts of partially filled windows grows least, counts
being kept in an array by level (Csirik et al., 2006). Each task packs its own
rows in one pass, so nothing is shuffled and memory holds only open windows. When
its rows end, the task joins what is still open: the emptiest windows are cut to
fill the fullest, and the last one into powers of two, which need no padding.

Defined cases: a null text counts as empty and holds only the end id. A text that
holds an added token of the tokenizer file, like ``<|endoftext|>``, has its id there.
A very long text is encoded whole and its full windows close at once. Repeated
rows and null ids are packed as rows of their own. An empty table gives none.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.llm.common import table
from sloscope.llm.pieces import chunks

TOKENIZER, WINDOW, END = "byte_bpe_50k.json", 1024, 0
#: Windows of one task are numbered from its partition's multiple of this.
TASK_SPAN = 1 << 40


class SumOfSquaresPacker:
    """Pieces are (tag, start, ids packed in 4 bytes each); closed windows come out as lists of them."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def _place(self, size: int) -> int:
        """The level (0: a new window) whose choice keeps the sum of squares least; ties to the fuller."""
        levels = np.arange(self.window - size + 1)
        counts = self.counts
        change = np.where(levels > 0, 1 - 2 * counts[levels], 0) + np.where(levels + size < self.window, 2 * counts[levels + size] + 1, 0)
        change[(levels > 0) & (counts[levels] == 0)] = np.iinfo(np.int64).max
        return int(len(levels) - 1 - np.argmin(change[::-1]))

    def add(self, tag, ids: bytes) -> Iterator[list]:
        window, n = self.window, len(ids) // 4
        start = 0
        while n - start >= window:
            yield [(tag, start, ids[4 * start : 4 * (start + window)])]
            start += window
        size = n - start
        if not size:
            return
        level = self._place(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
        else:
            pieces = []
        pieces.append((tag, start, ids[4 * start :]))
        if level + size == window:
            yield pieces
        else:
            self.counts[level + size] += 1
            self.open[level + size].append(pieces)

    def close(self) -> Iterator[list]:
        """All windows still open, joined so that padding is left in none."""
        rest = sorted(((level, pieces) for level, all_ in self.open.items() for pieces in all_), key=lambda x: x[0])
        spare: list = []  # pieces of the emptiest windows, to be cut
        low, high, have = 0, len(rest) - 1, 0
        while low <= high:
            level, pieces = rest[high]
            high -= 1
            need = self.window - level
            while have < need and low <= high:
                spare += rest[low][1]
                have += rest[low][0]
                low += 1
            taken, spare = _cut(spare, min(need, have))
            have -= min(need, have)
            if sum(len(x[2]) // 4 for x in taken) == need:
                yield pieces + taken
            else:
                spare = pieces + taken + spare
                have = sum(len(x[2]) // 4 for x in spare)
        while have:
            size = min(self.window, 1 << have.bit_length() - 1)
            taken, spare = _cut(spare, size)
            have -= size
            yield taken


def _cut(pieces: list, size: int) -> tuple[list, list]:
    """The first ``size`` ids of the pieces, and what is left."""
    taken, left = [], list(pieces)
    while size:
        tag, start, ids = left.pop(0)
        n = len(ids) // 4
        if n > size:
            left.insert(0, (tag, start + size, ids[4 * size :]))
            ids, n = ids[: 4 * size], size
        taken.append((tag, start, ids))
        size -= n
    return taken, left


_encoders: dict[str, tuple[tiktoken.Encoding, tuple[str, ...]]] = {}


def _byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 is itself, the rest follows U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(name: str) -> tuple[tiktoken.Encoding, tuple[str, ...]]:
    """A tokenizer file's byte-level BPE, loaded once in a worker, and the file's added tokens.

    The ids are those of the tokenizers library as loaded, with add_special_tokens=False
    (tested against it): nothing is added to a text, but an added token that stands in
    it is that one id. The library's own encoder takes four times the CPU time for them.
    """
    if name not in _encoders:
        spec = json.loads(Path(public_tokenizers.path(name)).read_text())
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{name}: only added tokens that match as they stand are supported")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, token)): k for token, k in spec["model"]["vocab"].items() if token not in added}
        _encoders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), tuple(added)
    return _encoders[name]


def token_ids(text: str, name: str = TOKENIZER) -> bytes:
    """The text's ids, packed as little-endian unsigned 32-bit integers."""
    encoding, added = encoder(name)
    ids = encoding.encode(text, allowed_special="all") if any(t in text for t in added) else encoding.encode_ordinary(text)
    return np.array(ids, "<u4").tobytes()


def _pack(batches: Iterator[pa.RecordBatch], name: str, window: int) -> Iterator[pa.RecordBatch]:
    packer = SumOfSquaresPacker(window)
    number = TaskContext.get().partitionId() * TASK_SPAN
    end = np.uint32(END).tobytes()

    def rows(windows: list[list]) -> pa.RecordBatch:
        nonlocal number
        columns: list[list] = [[] for _ in range(7)]
        for held in windows:
            offset = 0
            for (doc, total), start, ids in held:
                for column, value in zip(columns, (doc, start, len(ids) // 4, ids, total, number, offset)):
                    column.append(value)
                offset += len(ids) // 4
            number += 1
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        source = zip(batch.column("doc_id").to_pylist(), (t.as_py() or "" for t in batch.column("text")))
        for part in chunks(source):
            closed = []
            for doc, text in part:
                ids = token_ids(text, name) + end
                closed += packer.add((doc, len(ids) // 4), ids)
            yield rows(closed)
    yield rows(list(packer.close()))


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """Each document's ids, then the end id, as pieces of windows; ids are little-endian unsigned 32-bit."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(partial(_pack, name=tokenizer, window=window), schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
