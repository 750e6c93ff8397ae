"""Exact dedup against immutable snapshots screened by static binary-fuse filters.

A snapshot is the set of digests accepted so far, cut into hash buckets with one
immutable filter each. Incoming digests are pre-aggregated, sent to their bucket
and screened there; only positives are joined to the bucket's exact rows, and
duplicates among the new rows are grouped on their own. Whatever still looks
equal is compared byte for byte on the normalised text before it counts.

Defined cases: a null text counts as empty; texts are equal when identical after
each run of ASCII white space became one space; the smallest doc_id stays, a null
doc_id sorts last, and of repeated rows with one doc_id the first read stays. An
empty table gives an empty result. Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.llm import fuse
from sloscope.llm.common import SPACE, blocks_for, stash, table, text_or_empty, whole_row

#: Digests in one filter; a filter of this many keys takes about 5 KB.
KEYS_PER_FILTER = 4096
#: Digests (8 bytes each) that may be broadcast; beyond it a salted shuffle join is used.
BROADCAST_DIGESTS = 500_000
#: Salts at least, and rows of one hot digest's share of a salt: their number grows with the input.
SALTS, ROWS_PER_SALT = 16, 2_000_000


@dataclass(frozen=True)
class Snapshot:
    """Immutable: exact rows (h, sha, keep, n, bucket) and one filter for each bucket."""

    rows: DataFrame
    filters: DataFrame
    buckets: int


def normal_text():
    return F.regexp_replace(text_or_empty(), SPACE + "+", " ")


def digest_rows(docs: DataFrame) -> DataFrame:
    """rid, doc_id, h (XXH64 of the normalised text), sha; one row per input row, written once."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_text().alias("norm"))
    return stash(norm.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha")), "exact-digests")


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per digest, summed on the map side first; keep orders a null doc_id last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("keep")
    return rows.groupBy("h", "sha").agg(first, F.count("*").alias("n")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))


def _build_filter(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "blob": [fuse.build(pdf["h"].to_numpy(np.int64).view(np.uint64))]})


def take_snapshot(rows: DataFrame, buckets: int) -> Snapshot:
    exact = stash(_grouped(rows, buckets), "exact-snapshot")
    filters = exact.select("bucket", "h").groupBy("bucket").applyInPandas(_build_filter, "bucket int, blob binary")
    return Snapshot(exact, stash(filters, "exact-filters"), buckets)


def _screen(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    keys = left["h"].to_numpy(np.int64)
    hit = np.zeros(len(keys), bool) if right.empty else fuse.contains(right["blob"].iloc[0], keys.view(np.uint64))
    return left[hit]


def screen(incoming: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The incoming digests (h, bucket) that their bucket's filter may hold."""
    pairs = incoming.select("h", "bucket").groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket"))
    return pairs.applyInPandas(_screen, "h long, bucket int")


def _byte_groups(docs: DataFrame, digests: DataFrame, total: int) -> DataFrame:
    """Exact classes among the rows whose digest is in ``digests``: h, sha, size by comparing bytes."""
    digests = stash(digests, "exact-suspects")
    rows = docs.select(normal_text().alias("norm")).withColumn("h", F.xxhash64("norm"))
    if digests.count() <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(digests), "h", "left_semi")
    else:
        salts = blocks_for(total, ROWS_PER_SALT, SALTS)
        spread = digests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", (F.rand(7) * salts).cast("int")).join(spread, ["h", "salt"], "left_semi").drop("salt")
    return rows.groupBy("h", "norm").agg(F.count("*").alias("size")).select("h", F.sha2("norm", 256).alias("sha"), "size")


def exact_dedup(docs: DataFrame, split_at: int | None = None) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Rows with doc_id up to ``split_at`` form the snapshot, the others (and null
    ids) arrive as the new batch; by default the ids' middle cuts them.
    """
    rows = digest_rows(docs)
    low, high, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if split_at is None:
        split_at = 0 if low is None else (low + high) // 2
    buckets = blocks_for(count, KEYS_PER_FILTER)
    old = F.coalesce(F.col("doc_id") <= F.lit(split_at), F.lit(False))
    snapshot = take_snapshot(rows.filter(old), buckets)
    fresh = stash(_grouped(rows.filter(~old), buckets), "exact-fresh")
    positive = screen(fresh, snapshot)
    met = stash(fresh.join(positive.select("h").distinct(), "h", "left_semi").join(snapshot.rows.select("h", "sha"), ["h", "sha"]).select("h", "sha"), "exact-met")
    suspects = met.select("h").union(snapshot.rows.filter("n > 1").select("h")).union(fresh.filter("n > 1").select("h")).distinct()
    sizes = _byte_groups(docs, suspects, count)
    heads = snapshot.rows.select("h", "sha", "keep").union(fresh.select("h", "sha", "keep")).groupBy("h", "sha").agg(F.min("keep").alias("keep"))
    # written, so that the join below is between plain shuffles and a hot group can be split
    groups = stash(sizes.filter("size > 1").join(heads, ["h", "sha"]), "exact-groups")
    out = rows.join(groups, ["h", "sha"], "left")
    return out.select(
        "rid", "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("keep.rid") == F.col("rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they came."""
    found = exact_dedup(docs.select("doc_id", "text"))
    doubled = stash(found.filter("group_size > 1").select(F.col("text_sha256").alias("_sha")).distinct(), "exact-doubled")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b")).alias("_order")
    marked = docs.select(whole_row(docs), order, F.sha2(normal_text(), 256).alias("_sha"))
    if doubled.count() <= BROADCAST_DIGESTS // 8:
        doubled = F.broadcast(doubled)
    alone = marked.join(doubled, "_sha", "left_anti").select("_row")
    heads = marked.join(doubled, "_sha", "left_semi").groupBy("_sha").agg(F.min_by("_row", "_order").alias("_row")).select("_row")
    return alone.union(heads).select("_row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("rid")


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)"""
}
