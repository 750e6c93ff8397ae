"""Substring dedup: every byte inside a 400-byte string that also starts elsewhere goes.

Each 250-byte window belongs to one anchor, the window's least hashed 32-gram, so equal
windows have equal anchors at equal offsets, and one anchor stands for some 110 windows.
A 400-byte string belongs to the anchor of its first 250 bytes. An anchor's context are
all bytes of the strings that belong to it; contexts equal in 128 bits repeat whole, and
anchors with one context end there. What remains are borders of repeats: the distinct
contexts of an anchor are ordered by the text after the anchor and by the reversed text
before it, each a sparse suffix array built by deep-shallow sorting. Strings of either
length at one offset are equal when both orders put them in one interval of sufficient
common prefix. Strings of 400 bytes are removed; those of 250 are only counted, as a sign
of shorter passages that repeat. Both lengths are parameters.

An anchor with very many distinct contexts would gather them in one task; they are cut
by the place of the anchor in the window instead. Windows that have it in one half of
the places all hold the bytes between the first and the last of them, so a cut context
goes to the group of those bytes, and equal ones are found whole again. A group is cut
until it is small, at the latest where one place and so one 250-byte window is left.

Defined cases: a null text is empty; texts below 400 bytes keep all their bytes;
matches never cross documents; overlapping repeats count; repeated rows (one id,
one text) repeat each other and each goes whole. Rows are known by 128 bits of the
hash of id and text. Very long texts are hashed in overlapping pieces. The remaining
text leaves out characters of which some bytes are removed. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.llm.common import passing, stash, table, text_or_empty
from sloscope.llm.deepsort import deep_shallow

#: Bytes of a string that goes where it repeats; bytes of one that is only counted, some 40 words.
LENGTH, SHORT = 400, 250
#: Bytes whose hash makes an anchor; it begins at most ``SHORT - GRAM`` bytes after its window's start.
GRAM = 32
#: Bytes hashed together; larger documents are taken in pieces. At most 1 << PLACE.
PLACE, PIECE = 18, 200_000
#: Distinct contexts of one anchor that are sorted together (about 600 bytes each).
GROUP = 20_000
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each position that has as many."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * _C[0]
        h ^= h >> np.uint64(29)
        h = h[:-8] * _C[1] + h[8:]
        h ^= h >> np.uint64(32)
        h = h[:-16] * _C[2] + h[16:]
        h ^= h >> np.uint64(31)
        h *= _C[3]
        h ^= h >> np.uint64(30)
    return h


def window_anchors(h: np.ndarray, short: int) -> np.ndarray:
    """For each window start, the position of the leftmost least hash in reach."""
    reach = short - GRAM
    n, width = len(h) - reach, reach + 1
    key = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(h) // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    block[: len(h)] = key
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[reach : reach + n])
    return (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def context_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits, as two long columns, of the hash of the bytes [start, end)."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist())]), "<i8").reshape(-1, 2)


def anchors(data: bytes, ends: np.ndarray, limits: np.ndarray, length: int, short: int) -> tuple[np.ndarray, ...]:
    """Of documents joined in ``data`` and ending at ``ends``, for each anchor of windows that start in their first ``limits`` bytes:
    document number, gram and context hashes, first window, offset of the anchor in it, number of further windows, bytes of the context."""
    none = np.zeros(0, np.int64)
    nothing = none, none.astype(np.uint64), none.reshape(0, 2), none, none, none, none
    h = gram_hashes(data)
    if len(data) < short:
        return nothing
    at = window_anchors(h, short)
    place = np.arange(len(at))
    owner = np.searchsorted(ends, place, side="right")
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.flatnonzero((ends[owner] - place >= short) & (place - starts[owner] < limits[owner]))
    if not len(inside):
        return nothing
    at = at[inside]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1))))
    last = np.concatenate((first[1:], [len(at)])) - 1
    low, high, place = inside[first], inside[last], at[first]
    end = np.minimum(high + length, ends[owner[low]])
    return owner[low], h[place], context_hashes(data, low, end), low, place - low, high - low, end - low


#: A row, known by 128 bits of the hash of its id and text.
ROW = ("_rh", "_rg")
#: ``shape`` is the anchor's offset, the number of further windows and the bytes of the context, 20 bits each.
_ANCHORS = "_rh long, _rg long, gram long, context long, context2 long, low long, shape long"
_BITS = 20


def _anchor_rows(batches: Iterator[pa.RecordBatch], piece: int, length: int, short: int) -> Iterator[pa.RecordBatch]:
    def rows(held: list) -> pa.RecordBatch:
        ends = np.cumsum([len(x[-1]) for x in held])
        starts = ends - [len(x[-1]) for x in held]
        number, gram, context, low, back, more, size = anchors(b"".join(x[-1] for x in held), ends, np.full(len(held), piece), length, short)
        *key, base = (np.array([x[k] for x in held], np.int64) for k in range(3))
        columns = (*(k[number] for k in key), gram.view(np.int64), context[:, 0].copy(), context[:, 1].copy(), low - starts[number] + base[number], back | more << _BITS | size << 2 * _BITS)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*ROW, "gram", "context", "context2", "low", "shape"])

    for batch in batches:
        held, size = [], 0
        for *key, text in zip(*(batch.column(c).to_pylist() for c in ROW), batch.column("bytes")):
            data = text.as_py()
            if len(data) < short:
                continue
            for base in range(0, len(data) - short + 1, piece):
                part = data[base : base + piece + length - 1]
                if held and size + len(part) > piece + length:
                    yield rows(held)
                    held, size = [], 0
                held.append((*key, base, part))
                size += len(part)
        if held:
            yield rows(held)


def _keyed(docs: DataFrame, *carried: str | Column) -> DataFrame:
    """The row's key and the text as bytes."""
    own = [F.col("doc_id").cast("long"), text_or_empty()]
    return docs.select(*carried, F.xxhash64(*own).alias("_rh"), F.xxhash64(F.lit("row"), *own).alias("_rg"), own[1].cast("binary").alias("bytes"))


#: A context: its group, the row it stands in, its first byte, its anchor, the anchor's offset in the first window,
#: the number of further windows, whether no other context equals it, and its bytes.
_CONTEXTS = "gram long, _rh long, _rg long, low long, at long, back int, more int, lone boolean, bytes binary"
_NAMES = ["gram", *ROW, "low", "at", "back", "more", "lone", "bytes"]
_KINDS = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = (1 << _BITS) - 1
    for batch in batches:
        out: list[list] = [[] for _ in _NAMES]
        for *key, data, needs in zip(*(batch.column(c).to_pylist() for c in (*ROW, "bytes", "needs"))):
            for x in needs:
                low, shape = x["low"], x["shape"]
                back, more, size = shape & mask, shape >> _BITS & mask, shape >> 2 * _BITS
                for column, value in zip(out, (x["gram"], *key, low, low + back, back, more, x["lone"], data[low : low + size])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _KINDS)], names=_NAMES)


def _halves(batches: Iterator[pa.RecordBatch], places: list[tuple[int, int]], length: int, short: int) -> Iterator[pa.RecordBatch]:
    """Contexts cut to the windows that have the anchor at some of the ``places``, for each of these ranges."""
    digest, join = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
    names, kinds = [*_NAMES, "context", "context2"], [*_KINDS, pa.int64(), pa.int64()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for gram, *key, low, at, back, more, lone, data in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
            for first, last in places:
                b, least = min(last, back), max(first, back - more)
                if least > b:
                    continue
                own = data[back - b : back - least + length]
                shared = own[b - first : b - last + short]  # what all windows of these places have in common
                name = join(shared, (gram ^ first) & (2**64 - 1)) - 2**63
                context = np.frombuffer(digest(own + b.to_bytes(4, "little")), "<i8").tolist()
                for column, value in zip(out, (name, *key, at - b, at, b, b - least, lone, own, *context)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def repeated_offsets(contexts: list[bytes], back: np.ndarray, more: np.ndarray, group: np.ndarray, lengths: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
    """For each length (context, first, last): offsets of the anchor in strings that also stand in another context of the group.

    The last length is that of the windows, whose offsets a context has.
    """
    n = len(contexts)
    after, lcp_after = deep_shallow([c[b:] for c, b in zip(contexts, back)], group)
    before, lcp_before = deep_shallow([c[:b][::-1] for c, b in zip(contexts, back)], group)

    def best(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.maximum(lcp, np.concatenate((lcp[1:], [-1])))
        return out

    def of(length: int) -> list[tuple[int, int, int]]:
        low = np.maximum(back - more, length - best(after, lcp_after))
        high = np.minimum(back, best(before, lcp_before))
        seen = np.zeros((n, int(back.max()) + 2), bool)
        hopeful = low <= high
        rank_after, rank_before = np.empty(n, np.int64), np.empty(n, np.int64)
        for offset in range(max(0, int(low[hopeful].min())), int(high[hopeful].max()) + 1) if hopeful.any() else ():
            own = np.flatnonzero((back - more <= offset) & (offset <= back) & hopeful)
            if len(own) < 2:
                continue
            rank_after[after] = np.cumsum(lcp_after < length - offset)
            rank_before[before] = np.cumsum(lcp_before < offset)
            key = rank_before[own] * (n + 1) + rank_after[own]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            again = np.zeros(len(own), bool)
            again[by[1:][same]] = True
            again[by[:-1][same]] = True
            seen[own[again], offset] = True
        edge = np.diff(seen.astype(np.int8), axis=1, prepend=0)
        begin, end = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return list(zip(begin[0].tolist(), begin[1].tolist(), (end[1] - 1).tolist()))

    return [of(length) for length in lengths]


#: Bytes from ``start`` up to ``stop`` stand in repeated windows, up to ``deep`` in repeated strings of the full length.
_SPANS = "_rh long, _rg long, start long, stop long, deep long"


def _border_spans(batches: Iterator[pa.RecordBatch], length: int, short: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram; groups are sorted together until there are enough of them."""

    def settle(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        rows = rows.reset_index(drop=True)
        back, more = rows["back"].to_numpy(np.int64), rows["more"].to_numpy(np.int64)
        group = pd.factorize(rows["gram"])[0].astype(np.int64)
        keep = rows["lone"].to_numpy(bool)
        for size, found in zip((length, short), repeated_offsets(rows["bytes"].tolist(), back, more, group, (length, short))):
            found = np.array([x for x in found if keep[x[0]]], np.int64).reshape(-1, 3)
            own = found[:, 0]
            at = rows["at"].to_numpy(np.int64)[own]
            start, stop = at - found[:, 2], at - found[:, 1] + size
            columns = (*(rows[c].to_numpy(np.int64)[own] for c in ROW), start, stop, stop if size == length else start)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*ROW, "start", "stop", "deep"])

    held = None
    for batch in batches:
        now = batch.to_pandas()
        held = now if held is None else pd.concat((held, now), ignore_index=True)
        if len(held) >= GROUP // 2:
            whole = held["gram"] != held["gram"].iloc[-1]
            if whole.any():
                yield from settle(held[whole])
                held = held[~whole]
    if held is not None and len(held):
        yield from settle(held)


_SAME = ["gram", "context", "context2"]


def _whole(more: Column, size: Column, length: int, short: int) -> list[Column]:
    """The span of a context that repeats whole."""
    low = F.col("low")
    return [low.alias("start"), (low + more + short).alias("stop"), (low + F.when(size >= length, size).otherwise(0)).alias("deep")]


def _mixed_spans(contexts: DataFrame, length: int, short: int) -> DataFrame:
    """Spans of strings that repeat in distinct contexts (columns of _CONTEXTS), groups of more than GROUP being cut until none is left."""
    places, spans = [(0, short - GRAM)], None
    while True:
        large = stash(contexts.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("gram"), "suffix-large")
        small = contexts.join(large, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
        found = small.mapInArrow(partial(_border_spans, length=length, short=short), _SPANS)
        spans = found if spans is None else spans.union(found)
        if large.isEmpty():
            return spans
        places = [part for a, b in places for part in ((a, (a + b) // 2), ((a + b) // 2 + 1, b)) if part[0] <= part[1]]
        halves = contexts.join(large, "gram").select(*_NAMES).mapInArrow(partial(_halves, places=places, length=length, short=short), f"{_CONTEXTS}, context long, context2 long")
        halves = stash(halves, "suffix-halves")
        one = F.min(F.struct(*(c for c in _NAMES if c not in ("gram", "lone", "bytes")), "bytes")).alias("one")
        again = stash(halves.groupBy(*_SAME).agg(F.count("*").alias("n"), F.max("lone").alias("lone"), one), "suffix-again")
        whole = halves.join(again.filter("n > 1").select(*_SAME), _SAME)
        spans = spans.union(whole.select(*ROW, *_whole(F.col("more"), F.length("bytes"), length, short)))
        mixed = stash(again.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1").select("gram"), "suffix-mixed")
        kept = again.join(mixed, "gram").select("gram", "one.*", (F.col("lone") & (F.col("n") == 1)).alias("lone"))
        contexts = stash(kept.select(*_NAMES), "suffix-cut")
        if all(a == b for a, b in places):  # one window, in contexts that go on differently
            low = F.col("low")
            return spans.union(contexts.select(*ROW, low.alias("start"), (low + short).alias("stop"), low.alias("deep")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """The key and spans (array of start, stop, deep in bytes; they may overlap) of rows of ``_keyed`` with any repeat."""
    if not GRAM <= short <= length < 1 << _BITS - 1:
        raise ValueError("lengths must be at least a gram's, and the short one the lesser")
    with passing(docs.sparkSession):
        found = docs.mapInArrow(partial(_anchor_rows, piece=PIECE, length=length, short=short), _ANCHORS)
        found = stash(found.withColumn("aid", F.monotonically_increasing_id()), "suffix-anchors")
        contexts = stash(found.groupBy(*_SAME).agg(F.count("*").alias("n"), F.min("aid").alias("one")), "suffix-contexts")
        # written, so that the joins are between plain shuffles and a hot anchor's or context's rows can be split
        mixed = stash(contexts.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1").select("gram", F.lit(True).alias("mixed")), "suffix-mixed")
        known = contexts.join(mixed, "gram", "left").filter("n > 1 OR mixed")
        known = stash(known.select(*_SAME, (F.col("n") > 1).alias("again"), F.when(F.col("mixed"), F.col("one")).alias("one")), "suffix-known")
        met = found.join(known, _SAME).filter("again OR one = aid")
        met = met.select(*ROW, "gram", "low", "shape", "again", F.coalesce(F.col("one") == F.col("aid"), F.lit(False)).alias("stands"))
        met = stash(met, "suffix-met", keep=True)
    needs = met.filter("stands").groupBy(*ROW).agg(F.collect_list(F.struct("gram", "low", "shape", (~F.col("again")).alias("lone"))).alias("needs"))
    sliced = stash(docs.join(needs, list(ROW)).mapInArrow(_slices, _CONTEXTS).dropDuplicates(["gram", *ROW, "low", "at"]), "suffix-slices")
    more = F.shiftright("shape", _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))
    whole = met.filter("again").select(*ROW, *_whole(more, F.shiftright("shape", 2 * _BITS), length, short))
    spans = whole.union(_mixed_spans(sliced, length, short))
    return spans.groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop", "deep")).alias("spans"))


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary, text string, removed array<struct<start: bigint, end: bigint>>"


def _runs(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of bytes, in order."""
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        elif start < end:
            runs.append([start, end])
    return runs


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept", "text", "removed"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc, data, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bytes", "spans"))):
            runs = _runs((x["start"], x["deep"]) for x in spans or ())
            repeated = sum(b - a for a, b in _runs((x["start"], max(x["stop"], x["deep"])) for x in spans or ()))
            left = [data[a:b] for (_, a), (b, _) in zip([(0, 0), *runs], [*runs, (len(data), 0)])]
            kept, text = b"".join(left), "".join(x.decode(errors="ignore") for x in left)
            for column, value in zip(out, (doc, len(data), len(data) - len(kept), len(runs), repeated, kept, text, [{"start": a, "end": b} for a, b in runs])):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """Each row's remaining bytes, the maximal runs removed from it, and its bytes in repeated strings of the short length."""
    keyed = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    spans = repeated_spans(keyed.select(*ROW, "bytes"), length, short)
    return keyed.join(spans, list(ROW), "left").select("doc_id", "bytes", "spans").mapInArrow(_strip, _KEPT)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, the remaining text, and the bytes in strings of 250 bytes that also start elsewhere."""
    done = suffix_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated", "text")


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
#: Every window is hashed and counted; hex keeps bytes that are no whole character.
ORACLES = {
    "op3_suffix_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(b) AS n FROM documents),
        w AS (SELECT r, s, sha256(b[s + 1:s + 400]) AS m FROM (SELECT r, b, unnest(range(n - 399)) AS s FROM d WHERE n >= 400)),
        hit AS (SELECT r, s, s - lag(s) OVER (PARTITION BY r ORDER BY s) AS gap FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
        numbered AS (SELECT r, s, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS k FROM hit),
        gone AS (SELECT r, min(s) AS a, max(s) + 400 AS z FROM numbered GROUP BY r, k),
        cuts AS (SELECT r, a, z FROM gone UNION ALL SELECT r, n, n FROM d),
        left_over AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a, z), 0) AS f, a AS t FROM cuts),
        part AS (SELECT r, f, hex(b[f + 1:t]) AS x FROM left_over JOIN d USING (r) WHERE t > f),
        whole AS (SELECT r, f, x, regexp_replace(regexp_replace(x, '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-7]([89AB][0-9A-F]){0,2})$', '') AS y FROM part),
        joined AS (SELECT r, string_agg(x, '' ORDER BY f) AS x, string_agg(decode(unhex(y)), '' ORDER BY f) AS text FROM whole GROUP BY r),
        sums AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY r),
        w2 AS (SELECT r, s, sha256(b[s + 1:s + 250]) AS m FROM (SELECT r, b, unnest(range(n - 249)) AS s FROM d WHERE n >= 250)),
        hit2 AS (SELECT r, least(250, lead(s) OVER (PARTITION BY r ORDER BY s) - s) AS more FROM w2 WHERE m IN (SELECT m FROM w2 GROUP BY m HAVING count(*) > 1)),
        short AS (SELECT r, sum(coalesce(more, 250)) AS n_repeated FROM hit2 GROUP BY r)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(x, ''))) AS kept_sha256,
               coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(joined.text, '') AS text
        FROM d LEFT JOIN sums USING (r) LEFT JOIN joined USING (r) LEFT JOIN short USING (r)"""
}
