"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at three or fewer differing bits. Cut into two
segments of 32 bits, one segment of a linked pair differs by at most one bit, so
each segment is indexed exactly and with each single bit wildcarded; equal keys
meet and are verified on all 64 bits. Exact keys come first and give most links of
a dense group; the 64 one-wildcard keys then only meet what is still in different
components. A key with many distinct fingerprints of different components is cut
again on its free bits (four parts, of which a linked pair shares one) until it is
small, and before and after each cut keys with a single component left end. Large
keys are known by counts, so their members are never gathered; no bucket grows with
the data and no link is lost. Buckets yield a spanning forest of their links, not all
pairs; components are found over distinct fingerprints and copies only join the result.

Defined cases: a null text has no words; no words give fingerprint zero, linked
like any other; fewer words than a shingle make one shingle of the whole sequence.
A null doc_id gets a component like any row, but is its id only if all are null.
Repeated rows and ids stay rows of their own; a very long text is one row like any
other and is hashed in parts of 65,536 shingles. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sloscope.llm.common import KEY, row_key, stash, table, whole_row
from sloscope.llm.components import connected_components

BITS, NEAR = 64, 3
#: Distinct fingerprints compared directly in one bucket; larger buckets are cut again.
BUCKET = 4096
#: Segment values (8 bytes each) of large buckets that tasks may be told; were there more, tasks would find large buckets in their sorted rows.
HOT_VALUES = 1_000_000
#: Fingerprint pairs compared at once, which bounds a worker's memory.
PAIRS = 1 << 19
#: At so few free bits a bucket is small by construction and is compared whole.
FREE_BITS = 14
SEED = 42
BROADCAST_ROWS = 500_000

_HALF = (1 << 32) - 1


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 of all ``width``-word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(line, SEED)
    ends = list(accumulate(map(len, words)))
    first = [0, *(e + k for k, e in enumerate(ends[: n - width], 1))]
    hashes = np.fromiter((digest(line[a : e + k], SEED) for k, (a, e) in enumerate(zip(first, ends[width - 1 :]), width - 1)), np.uint64, n - width + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
        rest = [c for c in batch.schema.names if c != "_fp"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(prints.view(np.int64))], names=[*rest, "_fp"])


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` (any columns, ``text`` among them) with the fingerprint as a signed long in ``_fp``."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_fp", T.LongType())])
    return docs.mapInArrow(partial(_fingerprints, width=width), schema)


def _variants(batches: Iterator[pa.RecordBatch], wild: bool, large: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
    """Fingerprints (fp, root) under their 2 exact or 64 one-wildcard segment keys: kind in the high half; mask has the bits that a key fixes.

    ``large``: the exact keys, ascending, of buckets to be cut at once. Their rows and those
    of wildcard keys over them are left out, or with ``hot`` are the only ones.
    """

    def listed(keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(large, keys), len(large) - 1)
        return large[at] == keys if len(large) else np.zeros(len(keys), bool)

    for batch in batches:
        fp, root = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "root"))
        for at in range(0, len(fp), 65536):
            part, roots = fp[at : at + 65536], root[at : at + 65536]
            for s in range(2):
                own = (part >> np.uint64(32 * s)) & np.uint64(_HALF) | np.uint64(s << 32)
                for i in range(32) if wild else (None,):
                    bit = np.uint64(0 if i is None else 1 << i)
                    chosen = (listed(own) | listed(own ^ bit)) == hot
                    kind = s if i is None else 2 + 32 * s + i
                    key = own & np.uint64(_HALF) & ~bit | np.uint64(kind << 32)
                    if chosen.any():
                        yield _bucket_rows(key[chosen], part[chosen], roots[chosen], _fixed_bits(kind))


_BUCKETS = "key long, fp long, root long, mask long"


def _bucket_rows(key: np.ndarray, fp: np.ndarray, root: np.ndarray, mask: int) -> pa.RecordBatch:
    columns = (key, fp, root, np.full(len(key), mask, np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["key", "fp", "root", "mask"])


def _fixed_bits(kind: int) -> int:
    if kind < 2:
        return _HALF << 32 * kind
    s, i = divmod(kind - 2, 32)
    return (_HALF & ~(1 << i)) << 32 * s


def _parts(mask: int) -> list[int]:
    """The free bits of ``mask`` in four parts; of a linked pair one part is equal."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [sum(1 << b for b in free[k * len(free) // (NEAR + 1) : (k + 1) * len(free) // (NEAR + 1)]) for k in range(NEAR + 1)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large buckets under four finer keys each."""
    for batch in batches:
        key, fp, root, mask = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "fp", "root", "mask"))
        for m in np.unique(mask):
            own = mask == m
            for part in _parts(int(m)):
                with np.errstate(over="ignore"):
                    finer = (key[own] ^ np.uint64(part)) * np.uint64(0x9E3779B97F4A7C15) + (fp[own] & np.uint64(part))
                    finer = (finer ^ (finer >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    finer ^= finer >> np.uint64(32)
                yield _bucket_rows(finer, fp[own], root[own], int(m) | part)


def _forest(fp: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the components (``root``) of distinct fingerprints linked to each other."""
    n = len(fp)
    first = np.unique(root, return_inverse=True)[1]
    least = np.full(n, n)
    np.minimum.at(least, first, np.arange(n))
    known = least[first]
    label, step = known.copy(), max(1, PAIRS // n)
    while True:
        before = label.copy()
        for at in range(0, n, step):
            near = np.bitwise_count(fp[at : at + step, None] ^ fp[None, :]) <= NEAR
            label[at : at + step] = np.where(near, label[None, :], n).min(axis=1)
        np.minimum.at(least, first, label)  # a component moves as one
        label = least[first]
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    far = np.flatnonzero((label != known) & (known == np.arange(n)))
    return fp[far], fp[label[far]]


_LINKS = "hot boolean, key long, fp long, root long, mask long"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: edges (fp, and its partner in root), or members of a bucket too large as they are."""
    names = ("key", "fp", "root", "mask")

    def rows(hot: bool, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), hot)), *(pa.array(x.view(np.int64)) for x in columns)], names=["hot", *names])

    def cuttable(mask: np.ndarray) -> bool:
        return BITS - int(mask[0]).bit_count() > FREE_BITS

    def settle(key: np.ndarray, fp: np.ndarray, root: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets."""
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(key)])))
        two = starts[sizes == 2]
        near = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= NEAR) & (root[two] != root[two + 1])
        if near.any():
            two = two[near]
            yield rows(False, key[two], fp[two], fp[two + 1], mask[two])
        for a, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            run, at = np.unique(fp[a : a + n], return_index=True)
            own = root[a : a + n][at]
            if (own == own[0]).all():
                continue
            if len(run) > BUCKET and cuttable(mask[a : a + 1]):
                yield rows(True, np.full(len(run), key[a]), run, own, np.full(len(run), mask[a]))
            else:
                a_end, b_end = _forest(run, own)
                if len(a_end):
                    yield rows(False, np.full(len(a_end), key[a]), a_end, b_end, np.full(len(a_end), mask[a]))

    held = [np.zeros(0, np.uint64)] * 4
    over: int | None = None  # the key of a bucket that already went out as too large
    for batch in batches:
        now = [batch.column(c).to_numpy().view(np.uint64) for c in names]
        if not len(now[0]):
            continue
        held = [np.concatenate(x) for x in zip(held, now)]
        signed = held[0].view(np.int64)
        if over is not None:
            end = int(np.searchsorted(signed, np.uint64(over).view(np.int64), side="right"))
            if end:
                yield rows(True, *(x[:end] for x in held))
            held = [x[end:] for x in held]
            if not len(held[0]):
                continue
            over, signed = None, held[0].view(np.int64)
        last = int(np.searchsorted(signed, signed[-1]))
        if last:
            yield from settle(*(x[:last] for x in held))
            held = [x[last:] for x in held]
        if len(held[0]) > 4 * BUCKET and cuttable(held[3]):
            yield rows(True, *held)
            over = int(held[0][0])
            held = [np.zeros(0, np.uint64)] * 4
    if len(held[0]):
        yield from settle(*held)


def _met(level: DataFrame, hot: DataFrame, found: DataFrame | None) -> DataFrame:
    """The edges ``found`` so far and those of the keys of ``level`` and ``hot``; the latter's are cut, until none is left."""
    while True:
        out = stash(level.repartition("key").sortWithinPartitions("key").mapInArrow(_links, _LINKS), "simhash-links")
        edges = out.filter("not hot").select(F.col("fp").alias("a"), F.col("root").alias("b"))
        found = edges if found is None else found.union(edges)
        hot = hot.union(out.filter("hot").drop("hot"))
        if hot.isEmpty():
            return found
        hot = _rooted(hot.drop("root"), found)
        apart = F.min("root") != F.max("root")
        uneven = stash(hot.groupBy("key").agg(apart.alias("apart")).filter("apart").select("key"), "simhash-apart")
        finer = stash(hot.join(uneven, "key").select("key", "fp", "root", "mask").mapInArrow(_cut, _BUCKETS), "simhash-finer")
        fixed = F.bit_count(F.max("mask"))
        sizes = finer.groupBy("key").agg(apart.alias("apart"), ((F.count("*") > BUCKET) & (fixed < BITS - FREE_BITS)).alias("big"))
        finer = stash(finer.join(stash(sizes.filter("apart").select("key", "big"), "simhash-sizes"), "key"), "simhash-cut")
        level, hot = (finer.filter(c).select("key", "fp", "root", "mask") for c in ("not big", "big"))


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the component of their ``fp`` by the edges known so far."""
    roots = stash(connected_components(edges), "simhash-roots").toDF("fp", "root")
    return stash(rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")


def _large_values(distinct: DataFrame) -> np.ndarray:
    """Exact keys with more than BUCKET fingerprints, ascending; none where a task could not be told them all."""
    halves = F.array(*(F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(_HALF)) + F.lit(s << 32) for s in range(2)))
    large = stash(distinct.select(F.explode(halves).alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select("key"), "simhash-large")
    found = large.toArrow()["key"].to_numpy() if large.count() <= HOT_VALUES else np.zeros(0, np.int64)
    return np.sort(found.view(np.uint64))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges a, b whose components are those of all links between the distinct ``fp``."""
    large = _large_values(distinct)

    def family(rows: DataFrame, found: DataFrame | None, wild: bool) -> DataFrame:
        level, hot = (rows.mapInArrow(partial(_variants, wild=wild, large=large, hot=h), _BUCKETS) for h in (False, True))
        return _met(level, hot if len(large) else hot.limit(0), found)

    exact = family(distinct.select("fp", F.col("fp").alias("root")), None, False)
    return family(_rooted(distinct.select("fp"), exact), exact, True)


def fingerprint_pairs(marks: DataFrame) -> DataFrame:
    """a, b: pairs of ``node`` whose fingerprints (``_fp``) are equal or linked, enough to join all that are.

    ``marks`` has a row for each node and fingerprint. Linked fingerprints meet by one node
    of each, and so do nodes of one fingerprint: as many pairs as links of a forest.
    """
    marks = stash(marks.distinct(), "simhash-marks")
    ones = stash(marks.groupBy(F.col("_fp").alias("fp")).agg(F.min("node").alias("one"), F.count("*").alias("nodes")), "simhash-ones")
    links = stash(fingerprint_links(ones.select("fp")), "simhash-met")
    several, ends = ones.filter("nodes > 1"), links.select(F.col("a").alias("fp")).union(links.select("b")).distinct()
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    alike = marks.join(several, marks["_fp"] == several["fp"]).select(F.col("node").alias("a"), F.col("one").alias("b"))
    ends = stash(ones.join(ends, "fp", "left_semi").select("fp", "one"), "simhash-ends")
    near = links.join(ends.toDF("a", "one"), "a").join(ends.toDF("b", "other"), "b").select(F.col("one").alias("a"), F.col("other").alias("b"))
    return alike.union(near).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_components(prints: DataFrame, *carried: str) -> DataFrame:
    """fp, and the least value of each carried column over the fingerprint's component."""
    least = [F.min(c).alias(c) for c in carried]
    distinct = stash(prints.groupBy(F.col("_fp").alias("fp")).agg(*least, F.count("*").alias("copies")), "simhash-distinct")
    roots = stash(connected_components(fingerprint_links(distinct)), "simhash-roots")
    members = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "copies", *carried, F.coalesce("root", "fp").alias("root"))
    whole = members.groupBy("root").agg(*least, F.sum("copies").alias("size"))
    return members.select("fp", "root").join(whole, "root").select("fp", *carried, "size")


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stash(with_fingerprints(rows, width).select("doc_id", "_fp"), "simhash-prints")
    found = fingerprint_components(prints, "doc_id").select(F.col("fp").alias("_fp"), F.col("doc_id").alias("component_id"))
    return prints.join(found, "_fp").select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_heads(docs: DataFrame, width: int) -> DataFrame:
    """One row of each component stays (smallest doc_id, null last; then by text hash), with all its columns."""
    texts = docs.select(*row_key(), F.col("doc_id").isNull().alias("_no_id"), F.col("text").cast("string").alias("text"))
    prints = stash(with_fingerprints(texts, width).select(*KEY, "_no_id", "_fp"), "simhash-prints")
    ranks = prints.select("_fp", F.struct("_no_id", *KEY).alias("head"))
    found = fingerprint_components(ranks, "head").filter("size > 1").select(F.col("fp").alias("_fp"), F.struct(*(f"head.{c}" for c in KEY)).alias("stays"))
    return keep_one(docs, prints, found)


def keep_one(docs: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the rows (known by KEY in ``prints``) whose _fp is in ``found``, where another row stays.

    Rows are known by id and text hashes, so no copy of the texts is written. Rows
    alike in both are one row repeated, of which one stays, too.
    """
    members = prints.join(found, "_fp").groupBy(*KEY, "stays").agg(F.count("*").alias("n"))
    heads = F.struct(*KEY) == F.col("stays")
    gone = stash(members.filter(~heads | (F.col("n") > 1)).select(*KEY, heads.alias("again")), "simhash-gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    marked = docs.select(whole_row(docs), *row_key())
    alone = marked.join(gone, list(KEY), "left_anti").select("_row")
    again = marked.join(gone.filter("again"), list(KEY), "left_semi").groupBy(*KEY)
    return alone.union(again.agg(F.first("_row").alias("_row")).select("_row")).select("_row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
