"""Spelling variant grouping by two-dimensional range reporting over wavelet trees.

Words within one edit: take out place p of the longer word and what stands before and
behind is in both. Words of one length in forward order have those with a prefix in one
interval, in reverse order those with a suffix; each word is a point of both orders, and
for each place of a word the points in both intervals are its variants there, by another
letter or (asked by a word one shorter) by one letter more. A wavelet tree over the points
reports them in time of the levels times the answers (Mäkinen & Navarro, 2007).

No order holds the whole vocabulary: places 0 .. length are halved, a word goes to one
bucket by each half and the letters in the other, which an edit in the half leaves as they
are. Buckets with more than ROWS rows or LETTERS letters are halved again, at the worst
down to one place, where a bucket has as many words as there are letters. Tasks build one
tree over many whole buckets; a word's verdict (how many variants, the most frequent)
leaves a bucket, never its pairs.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. By the
count's contract one run in some 199, chosen by the CRC-32 of id and run, loses a letter.

Defined cases: a null or empty text has no words; a null doc_id counts as an empty string
in the CRC; repeated rows count each; ties of counts go to the word first in code-point
order; a word without variants is its own root. Very long words are words like any other,
and their matrices take a bucket's letters, no more. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.llm.common import stash, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Letters and occurrences of a word at least, how much more frequent a form is, one run in so many loses a letter.
LEAST_LETTERS, LEAST_COUNT, TIMES, LOSES = 6, 5, 5, 199
#: Rows and letters of a bucket; larger ones are halved again.
ROWS, LETTERS = 1 << 16, 1 << 22
#: Places of rows looked at in one step.
_CELLS = 1 << 20


def lossy_words(doc_id: int | None, text: str | None) -> Counter:
    """How often each word of LEAST_LETTERS or more stands in a text."""
    found: Counter = Counter()
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        h = zlib.crc32(word.encode(), before)
        if h % LOSES == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_LETTERS:
            found[word] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            total.update(lossy_words(doc_id.as_py(), text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words with LEAST_COUNT or more occurrences; batches are counted before they are shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


class WaveletTree:
    """Points (k, values[k]), ``values`` a permutation: one row of zero counts for each bit of the values, high bits first."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        for b in range(self.bits - 1, -1, -1):
            ones = (values >> b & 1).astype(bool)
            zeros = np.concatenate(([0], np.cumsum(~ones)))
            self.levels.append((zeros, int(zeros[-1])))
            values = np.concatenate((values[~ones], values[ones]))

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query number and value of every point with left <= k < right and low <= value < high, for arrays of queries."""
        query, value = np.arange(len(left)), np.zeros(len(left), np.int64)
        for b, (zeros, n) in zip(range(self.bits - 1, -1, -1), self.levels):
            l0, r0 = zeros[left], zeros[right]
            query, value = np.concatenate((query, query)), np.concatenate((value, value | 1 << b))
            left, right = np.concatenate((l0, left - l0 + n)), np.concatenate((r0, right - r0 + n))
            stay = (left < right) & (value < high[query]) & (value + (1 << b) > low[query])
            query, value, left, right = query[stay], value[stay], left[stay], right[stay]
        return query, value


class _Order:
    """Rows of one length sorted by bucket and letters, and the intervals in which they agree in a number of first letters."""

    def __init__(self, bucket: np.ndarray, letters: np.ndarray, listed: np.ndarray) -> None:
        n, width = letters.shape
        whole = np.empty((n, 4 + width), np.uint8)
        whole[:, :4] = bucket.astype(">u4").view(np.uint8).reshape(n, 4)
        whole[:, 4:] = letters
        self.order = np.argsort(whole.view(f"S{4 + width}").ravel(), kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        now = whole[self.order]
        apart = now[1:] != now[:-1]
        first = np.where(apart.any(axis=1), apart.argmax(axis=1), 4 + width) - 4
        self.shared = np.concatenate(([-1], np.where(first < 0, -1, first)))
        self.before = np.concatenate(([0], np.cumsum(listed[self.order])))

    def intervals(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and size, in the order of the rows as given: the listed points that agree in so many letters."""
        n = len(self.order)
        starts = self.shared[:, None] < sizes[None, :]
        index = np.arange(n)[:, None]
        left = np.maximum.accumulate(np.where(starts, index, 0), axis=0)
        ends = np.where(np.concatenate((starts[1:], np.ones((1, len(sizes)), bool))), index + 1, n)
        right = np.minimum.accumulate(ends[::-1], axis=0)[::-1]
        return self.before[left][self.place], self.before[right][self.place]


def variants(words: list[str], length: int, low: int, high: int, bucket: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b) that differ by one letter at a place of low .. high - 1, within buckets, and each row's code-point order in its bucket.

    ``listed`` rows have ``length`` letters and stand as a and b; the others have one less
    and stand as a: b is then a with one letter more. Each pair comes once for each a.
    """
    n = len(words)
    forward = np.array([w.encode("latin-1") for w in words], f"S{length}").view(np.uint8).reshape(n, length)
    backward = np.array([w[::-1].encode("latin-1") for w in words], f"S{length}").view(np.uint8).reshape(n, length)
    ahead, behind = _Order(bucket, forward, listed), _Order(bucket, backward, listed)
    first, second = (o.order[listed[o.order]] for o in (ahead, behind))
    number = np.empty(n, np.int64)
    number[second] = np.arange(len(second))
    tree = WaveletTree(number[first])
    found = []
    step = max(1, _CELLS // n)
    for at in range(low, high, step):
        places = np.arange(at, min(high, at + step))
        (left, right), (bottom, top) = ahead.intervals(places), behind.intervals(length - 1 - places)
        own = listed[:, None].astype(np.int64)
        a, p = np.nonzero((right - left > own) & (top - bottom > own))
        query, value = tree.report(left[a, p], right[a, p], bottom[a, p], top[a, p])
        a, p, b = a[query], places[p[query]], second[value]
        # one letter more in a run of that letter can stand at several places: the last one counts
        last = (p == length - 1) | (forward[b, p] != forward[b, np.minimum(p + 1, length - 1)])
        good = np.where(listed[a], a != b, last)
        found.append((a[good], b[good]))
    a, b = (np.concatenate(x) for x in zip(*found))
    return a, b, ahead.place


_ROWS = "key long, length int, low int, high int, listed boolean, word string, n long"
_VERDICTS = "word string, near long, best_n long, best string"


def _judged(rows: pa.Table) -> pa.RecordBatch:
    """Of rows of whole buckets of one length and span: for each word that has any, its variants' number and the most frequent."""
    words, n, listed = rows["word"].to_pylist(), rows["n"].to_numpy(), rows["listed"].to_numpy().astype(bool)
    bucket = np.unique(rows["key"].to_numpy(), return_inverse=True)[1]
    length, low, high = (rows[c][0].as_py() for c in ("length", "low", "high"))
    a, b, place = variants(words, length, low, high, bucket, listed)
    short = ~listed[a]
    a, b = np.concatenate((a, b[short])), np.concatenate((b, a[short]))
    order = np.lexsort((place[b], -n[b], a))
    a, b = a[order], b[order]
    own, first, near = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    columns = [pa.array([words[k] for k in own], pa.string()), pa.array(near, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[k] for k in best], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "near", "best_n", "best"])


def _spans(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Verdicts of whole buckets, sorted by length and span."""
    span = np.stack([rows[c].to_numpy() for c in ("length", "low", "high")])
    cuts = [0, *(np.flatnonzero((span[:, 1:] != span[:, :-1]).any(axis=0)) + 1), rows.num_rows]
    for at, end in zip(cuts, cuts[1:]):
        yield _judged(rows.slice(at, end - at))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length, span and key; the last bucket of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        keys = rows["key"].to_numpy()
        done = np.flatnonzero(keys != keys[-1])
        cut = int(done[-1]) + 1 if len(done) else 0
        held = rows.slice(cut).to_batches()
        if cut:
            yield from _spans(rows.slice(0, cut))
    if held:
        yield from _spans(pa.Table.from_batches(held))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row under the two halves of its span: each keeps the letters of the other half in its key."""
    middle = F.expr("int((low + high) div 2)")
    shift = F.when(F.col("listed"), 0).otherwise(1)
    lower = F.struct(F.col("low").alias("low"), F.col("middle").alias("high"), F.expr("substring(word, middle - shift + 1, high - middle)").alias("kept"))
    upper = F.struct(F.col("middle").alias("low"), F.col("high").alias("high"), F.expr("substring(word, low + 1, middle - low)").alias("kept"))
    cut = rows.withColumns({"middle": middle, "shift": shift}).select("key", "length", "listed", "word", "n", F.explode(F.array(lower, upper)).alias("half"))
    key = F.xxhash64("key", "half.low", "half.high", "half.kept")
    return cut.select(key.alias("key"), "length", "half.low", "half.high", "listed", "word", "n")


def _buckets(words: DataFrame) -> DataFrame:
    """Rows (_ROWS) of all buckets in which words can meet, none too large."""
    length = F.length("word")
    start = [F.struct((length + more).cast("int").alias("length"), F.lit(not more).alias("listed")) for more in (0, 1)]
    rows = words.select("word", "n", F.inline(F.array(*start)))
    rows = rows.select(F.xxhash64("length").alias("key"), "length", F.lit(0).alias("low"), F.col("length").alias("high"), "listed", "word", "n")
    found = None
    while True:
        rows = stash(_halved(rows), "spelling-halves")
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max("listed").alias("any"))
        large = ((F.col("size") > ROWS) | (F.col("size") * F.col("length") > LETTERS)) & (F.col("high") - F.col("low") > 1)
        sized = rows.join(stash(sizes.filter("size > 1 AND any").drop("any"), "spelling-sizes"), "key")
        small = sized.filter(~large).drop("size")
        found = small if found is None else found.union(small)
        rows = stash(sized.filter(large).drop("size"), "spelling-large")
        if rows.isEmpty():
            return found


def near_words(words: DataFrame) -> DataFrame:
    """word, near (number of words one edit away), best_n and best (the most frequent of them) of ``words`` (word, n) that have any."""
    ordered = _buckets(words).repartition("key").sortWithinPartitions("length", "low", "high", "key")
    found = ordered.mapInArrow(_met, _VERDICTS)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("one")
    return found.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("one.less")).alias("best_n"), "one.best")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: steps are doubled until no root has a form.

    Counts grow by TIMES with each step, so some dozen steps and four or five rounds are the most.
    """
    now = stash(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        if further.isEmpty():
            return now
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stash(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary."""
    words = stash(vocabulary(docs), "spelling-words")
    near = stash(near_words(words), "spelling-near")
    is_form: Column = F.col("best_n") >= TIMES * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    known = stash(known, "spelling-known")
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES = {
    "op12_spelling_variants": r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents
), counted AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, w, count(*) AS c FROM runs GROUP BY ALL),
crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), bytes AS (
    SELECT w, c, flatten(list_transform(string_split(id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM counted
), hashed AS (
    SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1]))) AS h FROM bytes, crc_table
), cut AS (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (SELECT word, k, word[:k - 1] || word[k + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (
    SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT less.word, words.word FROM less JOIN words ON less.rest = words.word
    UNION SELECT words.word, less.word FROM less JOIN words ON less.rest = words.word
), best AS (
    SELECT a AS word, count(*) AS n_near, min({'less': -n, 'b': b}) AS one FROM near JOIN words ON near.b = words.word GROUP BY a
), known AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -one.less >= 5 * n THEN one.b END AS form, CASE WHEN -one.less >= 5 * n THEN -one.less END AS form_n
    FROM words LEFT JOIN best USING (word)
), steps AS (
    SELECT word, word AS now, form AS next FROM known
    UNION ALL SELECT s.word, k.word, k.form FROM steps s JOIN known k ON k.word = s.next
)
SELECT word, form, (SELECT s.now FROM steps s WHERE s.word = known.word AND s.next IS NULL) AS root, n, n_near, form_n FROM known
""",
}
