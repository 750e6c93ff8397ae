"""Pre-token pieces of a text, each encoded once per worker and then looked up.

A byte-level BPE never merges across pre-tokens, so a text's ids are its pieces'
ids in a row. The memo is bounded: at its limit it starts anew, which costs time
and never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import regex

#: Pieces remembered by one worker, about 200 bytes each.
MEMO = 300_000
#: Characters of text handled at once.
CHUNK = 1_000_000


class PieceCodec:
    """Encodes texts to packed little-endian unsigned 32-bit ids; ``encode_many`` encodes new pieces."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], limit: int = MEMO):
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.encode_many, self.limit, self.memo = encode_many, limit, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        if len(self.memo) > self.limit:
            self.memo.clear()
        new = list(set().union(*pieces) - self.memo.keys())
        self.memo.update(zip(new, self.encode_many(new)))
        known = self.memo.__getitem__
        return [b"".join(map(known, p)) for p in pieces]


def chunks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows whose last field is a text, in lists of about CHUNK characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held
