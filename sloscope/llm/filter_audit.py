"""Filter interaction audit: what each filter removes at each place of every order, in DataFrame functions.

Each document is a mask of the filters that it fails. Masks are counted by part (at most
two to the number of filters a part, summed on the map side) and unpivoted to one cell a
filter; the cells meet the steps of all orders by their filter. A running bit-or over an
order's earlier steps tells what has removed a cell's documents already; conditional sums
give each step's metrics and a window over a filter's steps its total over all orders.

Filters (fixed values of the audit): A fewer than 200 words; B fewer than half of the words
distinct; C more than two capitals A-Z in 100 code points; D any of ``#$%&*|``; E the text
of a row with a smaller doc_id.

Defined cases: a null text is an empty one, with no words, so it fails A alone (and E
where an empty text has a smaller id). A null doc_id is larger than any id and has no
labels. Rows alike in id and text don't fail E for each other and count each. A null source
is the empty string. Of several label rows for one id any counts. An empty table gives an
empty result. Very long texts are rows like any other; further columns are never read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sloscope.llm.common import SPACE, stash, table, text_or_empty

FILTERS = "ABCDE"
#: Least words, least share of distinct words and largest share of capitals (both in 100).
LEAST_WORDS, DISTINCT, CAPITALS = 200, 50, 2
_BLANKS = " \t\n\x0b\x0c\r"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails by itself."""
    bare = F.btrim(text, F.lit(_BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT * n,
        "C": 100 * capitals.cast("long") > CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    mask = F.lit(0)
    for letter, failed in fails.items():
        mask = mask.bitwiseOR(F.when(failed, _bit(letter)).otherwise(0))
    return mask


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of each document."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    text = F.col("text")
    rows = stash(rows.select("doc_id", "part", own_mask(text).alias("own"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit("audit"), text).alias("tg")), "audit-rows")
    # one row a text that several rows have; written, so that the join on a text with very many copies can be split
    first = stash(rows.groupBy("th", "tg").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "audit-texts")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    again = F.coalesce((F.col("first_id") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("first_id").isNotNull()), F.lit(False))
    mask = F.col("own").bitwiseOR(F.when(again, _bit("E")).otherwise(0))
    met = rows.join(first, ["th", "tg"], "left").select("doc_id", "part", mask.alias("mask"))
    return met.join(marks, "doc_id", "left").select("part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def order_steps(spark: SparkSession) -> DataFrame:
    """letter, filter_order, step for every order of the filters: a table of fixed size."""
    rows = [(letter, "".join(order), step) for order in permutations(FILTERS) for step, letter in enumerate(order, 1)]
    return spark.createDataFrame(rows, "letter string, filter_order string, step int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    masks = judged(docs, labels).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    masks = stash(masks, "audit-masks")
    cells = masks.select("*", *(F.col("mask").bitwiseAND(F.lit(_bit(x))).alias(x) for x in FILTERS)).unpivot(["part", "mask", "n", "good", "toxic"], list(FILTERS), "letter", "own")
    steps = cells.join(F.broadcast(order_steps(docs.sparkSession)), "letter")
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("own").over(earlier), F.lit(0)))
    fails, before = F.col("own") != 0, F.col("earlier") != 0
    here = fails & ~before
    sums = {
        "kept": F.when(~fails & ~before, F.col("n")), "removed": F.when(here, F.col("n")), "redundant": F.when(fails & before, F.col("n")),
        "unique_fails": F.when(fails & (F.col("mask") == F.col("own")), F.col("n")), "good_lost": F.when(here, F.col("good")), "toxic_lost": F.when(here, F.col("toxic")),
    }
    out = steps.groupBy("part", "filter_order", "step", "letter").agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(c) for c, x in sums.items()))
    whole = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return out.select("part", "filter_order", "step", *sums, whole)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {
    "op13_filter_audit": r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
masks AS (
    SELECT part, doc_id,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS mask
    FROM texts JOIN firsts USING (text)
), marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
counts AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM masks LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
    FROM letters p, letters q, letters r, letters s, letters t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31
), steps AS (
    SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), sums AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
    FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM sums
""",
}
