"""Near-duplicates by SuperMinHash signatures, bands, verification and components.

A document's set is its distinct five-word shingles (XXH64). SuperMinHash (Ertl, 2017)
gives each element a random permutation of the signature's places: the element offers its
j-th place the rank j and a draw below one, and a place keeps its least offer. Ranks of one
element differ between places, which lowers the variance of the share of equal places, and
a set is done once every place holds a rank below the next. All elements of many sets take
one step together, so large sets end after a step or two.

Sets that share one of BANDS bands of DEPTH places are candidates. Two sets at 0.8 share
none with a probability of 5e-8, at 0.85 of 6e-11. Bands don't pair all members: each is
first compared with one member of the band, the one in most large bands and then one by
hash, and only what is then still in different components is paired. A band with more than
BUCKET such members is cut by the further bands that its members share, twice at most (two
sets at 0.8 share fewer than three bands with a probability of 1.2e-5), and what is still
larger is dealt into chunks that meet in cells of two, so no bucket is unbounded and none is
left out. Candidates must agree in as many places as the threshold makes all but certain
(six standard deviations). The parities of the elements dealt to PARITIES bits (Mitzenmacher,
Pagh & Pham, 2014) differ in no more bits than the sets in elements, so a pair with more
differing bits than the threshold allows is no link: in a group whose members are nearly
similar, pairs end in the join. Every link is verified on the whole sets. Where the texts'
SimHash fingerprints are taken along, the pairs that these link are verified first, and
bands only meet what is then still in different components.

Defined cases: a null or empty text and one without words have an empty set, linked with
nothing; fewer words than a shingle make one shingle of the whole sequence; case (A-Z) and
white space don't count. A null doc_id is larger than any id: a component's id is null only
if all its ids are. Repeated rows are equal sets and rows of their own; of rows with one id
each is kept if the id is the component's. Very long texts have their signatures taken in
parts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.llm.common import KEY, passing, row_key, stash, table
from sloscope.llm.components import connected_components
from sloscope.llm.simhash import _fingerprints, fingerprint_pairs

WIDTH = 5
SEED = 42
BANDS, DEPTH = 32, 4
PLACES = BANDS * DEPTH
#: Least similarity of a link, in hundredths.
NEAR = 85
#: Rounds in which a band's members are compared with one of them; members of a bucket that are then compared with each
#: other; how often a larger one is cut by further bands before it is dealt into chunks.
ROUNDS, BUCKET, CUTS = 2, 5_000, 2
#: Rows of a few longs that every task may be told.
BROADCAST_ROWS = 500_000
#: Elements and sets that take their steps together.
_PART, _SETS = 1 << 16, 512
#: Bits of a set's parities.
PARITIES = 512
#: Columns of 16 places each, four bits a place, and of 64 parities each.
SIGNS = tuple(f"s{k}" for k in range(PLACES // 16))
ODDS = tuple(f"p{k}" for k in range(PARITIES // 64))
#: An offer: the rank in the high bits, the draw below.
_DRAW = 57


def shingles(text: str | None) -> np.ndarray:
    """The distinct XXH64 of all five-word shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= WIDTH:
        return np.array([digest(line, SEED)], np.uint64)
    ends = list(accumulate(map(len, words)))
    first = [0, *(e + k for k, e in enumerate(ends[: n - WIDTH], 1))]
    return np.unique(np.fromiter((digest(line[a : e + k], SEED) for k, (a, e) in enumerate(zip(first, ends[WIDTH - 1 :]), WIDTH - 1)), np.uint64, n - WIDTH + 1))


def node_of(own: np.ndarray) -> int:
    """A set's name, as an unsigned integer."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Steele, Lea and Flood's mixer of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _offer(least: np.ndarray, owner: np.ndarray, x: np.ndarray) -> None:
    """Lowers ``least`` (sets x PLACES) by the offers of the elements ``x`` of the sets ``owner``, until no offer can be lower."""
    flat, perm = least.reshape(-1), None
    for j in range(PLACES):
        z = _mixed(x + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        chosen = (j + ((z >> np.uint64(32)) * np.uint64(PLACES - j) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        if perm is None:
            place = chosen
        else:
            rows = np.arange(len(x))
            place = perm[rows, chosen].astype(np.int64)
            perm[rows, chosen] = perm[:, j]
        np.minimum.at(flat, owner * PLACES + place, np.uint64(j << _DRAW) | _mixed(z ^ np.uint64(SEED)) >> np.uint64(64 - _DRAW))
        open_sets = (least.max(axis=1) >> np.uint64(_DRAW)) > j
        stay = open_sets[owner]
        x, owner = x[stay], owner[stay]
        if not len(x):
            return
        if perm is None:
            perm = np.broadcast_to(np.arange(PLACES, dtype=np.uint8), (len(x), PLACES)).copy()
            perm[np.arange(len(x)), chosen[stay]] = 0
        else:
            perm = perm[stay]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The signature of each set, sets x PLACES of unsigned 64 bits; all ones for an empty set."""
    least = np.full((len(sets), PLACES), np.iinfo(np.uint64).max)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and end - at < _SETS and (total := total + len(sets[end])) <= _PART:
            end += 1
        end = max(end, at + 1)
        own = np.concatenate(sets[at:end])
        owner = np.repeat(np.arange(end - at), [len(s) for s in sets[at:end]])
        for k in range(0, len(own), _PART):  # more than one part only for a single large set
            _offer(least[at:end], owner[k : k + _PART], own[k : k + _PART])
        at = end
    return least


def parities(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements is dealt to each of PARITIES bits, as longs."""
    dealt = np.bincount((_mixed(own) >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES)
    return np.packbits((dealt & 1).astype(np.uint8)).view(np.int64)


_PRINTS = "node long, n int, keys array<long>, signs array<long>"


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        names = [c for c in batch.schema.names if c != "text"]
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        least = signatures(sets)
        keys = [[digest(band.tobytes(), k) for k, band in enumerate(row.reshape(BANDS, DEPTH))] if len(s) else [] for s, row in zip(sets, least)]
        keys = [np.array(k, np.uint64).view(np.int64) for k in keys]
        bits = (_mixed(least) >> np.uint64(60)).astype(np.uint8)
        signs = (bits[:, ::2] | bits[:, 1::2] << 4).view(np.int64) if len(sets) else np.zeros((0, len(SIGNS)), np.int64)
        signs = [np.concatenate((row, parities(s))) for row, s in zip(signs, sets)]
        columns = [pa.array(np.array([node_of(s) for s in sets], np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int32())]
        columns += [pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, "node", "n", "keys", "signs"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_printed`` behind the SimHash fingerprint of three-word shingles, in one worker."""
    return _printed(_fingerprints(batches, 3))


def with_prints(texts: DataFrame, fingerprints: bool = False) -> DataFrame:
    """``texts`` with node (the set's name), n (its size), keys (of its bands) and signs (places and parities) in place of ``text``; with ``fingerprints`` also _fp."""
    kept = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text"), *(["_fp long"] if fingerprints else [])])
    return texts.mapInArrow(_marked if fingerprints else _printed, f"{kept}, {_PRINTS}")


def similar(a: np.ndarray, b: np.ndarray, near: int = NEAR) -> bool:
    """Whether the Jaccard similarity of two sets is ``near`` hundredths or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= near * (len(a) + len(b) - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], names=["node", "own"])


def _verified(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), near) for x, y in zip(batch.column("own_a"), batch.column("own_b"))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _told(rows: DataFrame) -> DataFrame:
    """``rows`` (a few longs each), told to every task where they are no more than BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _links(pairs: DataFrame, own: DataFrame, near: int) -> DataFrame:
    """Of the pairs a, b those that are similar."""
    pairs = stash(pairs.distinct(), "minhash-pairs")
    needed = stash(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "minhash-needed")
    own = own.join(_told(needed), "node", "left_semi")
    both = pairs.join(own.toDF("a", "own_a"), "a").join(own.toDF("b", "own_b"), "b")
    return stash(both.mapInArrow(partial(_verified, near=near), "a long, b long"), "minhash-links")


def least_alike(near: int) -> int:
    """Places in which four bits agree that a pair at ``near`` hundredths has but for one in a thousand million."""
    share = near / 100
    return int(PLACES * (share + (1 - share) / 16) - 6 * (PLACES * share * (1 - share)) ** 0.5)


def _may_match(x: str, y: str, near: int) -> Column:
    """Whether sets with columns of these suffixes can be similar by their sizes and parities, and look alike by their signatures."""
    alike, odd = F.lit(0), F.lit(0)
    for c in ODDS:
        odd = odd + F.bit_count(F.expr(f"{c}{x} ^ {c}{y}"))
    for c in SIGNS:
        apart = F.expr(f"{c}{x} ^ {c}{y}")
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, 1))
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, 2)).bitwiseAND(F.lit(0x1111111111111111))
        alike = alike + 16 - F.bit_count(apart)
    sizes = F.least(f"n{x}", f"n{y}").cast("long") * 100 >= F.greatest(f"n{x}", f"n{y}").cast("long") * near
    # of sets that are similar, at most this share of their elements is in one of them only
    few = odd.cast("long") * (100 + near) <= (F.col(f"n{x}").cast("long") + F.col(f"n{y}")) * (100 - near)
    return sizes & few & (alike >= least_alike(near))


_MEMBER = ("node", "n", "root", *SIGNS, *ODDS)


def _met(members: DataFrame, near: int, *by: str) -> DataFrame:
    """a, b that may match under one key and are in different components, under the first bands that they share."""
    carried = [c for c in members.columns if c not in by]
    one, other = (members.select(*by, *(F.col(c).alias(c + x) for c in carried)) for x in ("", "_b"))
    fits = (F.col("node") < F.col("node_b")) & (F.col("root") != F.col("root_b")) & _may_match("", "_b", near)
    again = F.expr("exists(sequence(1, band), k -> k < band AND NOT array_contains(used, k) AND get(keys, k - 1) = get(keys_b, k - 1))")
    return one.join(other, list(by)).filter(fits & ~again).select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def _apart(members: DataFrame) -> DataFrame:
    """The members of keys that have several components, and whether they are many."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), (F.min("root") != F.max("root")).alias("apart"))
    sizes = stash(sizes.filter("apart").select("key", "size"), "minhash-sizes")
    return stash(members.join(sizes, "key"), "minhash-apart")


def _pairs(members: DataFrame, heads: DataFrame, near: int) -> DataFrame:
    """a, b that may match in one band and different components; ``used`` are the bands that a key stands for, ``band`` their last."""
    members = members.join(heads.select("node", "keys"), "node").withColumn("band", F.array_position("keys", F.col("key")).cast("int")).withColumn("used", F.array("band"))
    found = None
    for cut in range(CUTS + 1):
        members = _apart(members)
        pairs = _met(members.filter(F.col("size") <= BUCKET).drop("size"), near, "key")
        found = pairs if found is None else found.union(pairs)
        large = members.filter(F.col("size") > BUCKET)
        if large.isEmpty():
            return found
        if cut < CUTS:
            further = F.expr(f"filter(sequence(1, {BANDS}), k -> k > band)")
            large = large.drop("size").withColumn("next", F.explode(further))
            members = large.withColumns({"key": F.xxhash64("key", "next", F.expr("get(keys, next - 1)")), "band": F.col("next"), "used": F.array_append("used", F.col("next"))}).drop("next")
    chunks = F.ceil(F.col("size") / BUCKET).cast("int")
    large = large.select("*", chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk")).drop("size")
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(k, F.col("chunk")) * F.col("chunks") + F.greatest(k, F.col("chunk")))
    return found.union(_met(large.withColumn("cell", F.explode(cells)).drop("chunks", "chunk"), near, "key", "cell"))


def similar_roots(heads: DataFrame, texts: DataFrame, near: int = NEAR, first: DataFrame | None = None) -> DataFrame:
    """node, root for each set that has a similar one; ``heads`` has node, n, keys, signs and a row (head) of each distinct set.

    Nodes are known by 64 bits of their sets' hash. ``texts`` has KEY and text. The pairs a, b
    of ``first`` are verified before the bands, whether they share one or not.
    """
    keyed = heads.select(F.explode("keys").alias("key"), "node")
    met = stash(keyed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1"), "minhash-met")
    weighed = stash(keyed.join(_told(met), "key"), "minhash-keyed")
    weights = weighed.groupBy("node").agg(F.sum("many").alias("weight"))
    known = stash(heads.join(weights, "node").select("node", "n", "weight", "head", *(F.col("signs")[k].alias(c) for k, c in enumerate((*SIGNS, *ODDS)))), "minhash-known")
    members = stash(weighed.select("key", "node").join(known.drop("head"), "node"), "minhash-members")
    wanted = known.select("node", *(f"head.{c}" for c in KEY))
    if first is not None:
        paired = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
        wanted = stash(wanted.union(heads.join(_told(paired), "node", "left_semi").select("node", *(f"head.{c}" for c in KEY))).distinct(), "minhash-wanted")
    own = texts.join(_told(wanted), list(KEY)).select("node", "text").mapInArrow(_sets, "node long, own binary")
    own = stash(own.dropDuplicates(["node"]), "minhash-sets")
    links, rooted = None, members.withColumn("root", F.col("node"))
    if first is not None:
        links = _links(first, own, near)
        rooted = stash(members.join(stash(connected_components(links), "minhash-roots"), "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-rooted")
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            order = F.struct((F.lit(0) if turn else -F.col("weight")).cast("long").alias("w"), F.xxhash64("node", F.lit(turn)).alias("o"), *(F.col(c).alias(f"{c}_b") for c in _MEMBER))
            one = rooted.groupBy("key").agg(F.min(order).alias("one"), (F.min("root") != F.max("root")).alias("apart"))
            one = stash(one.filter("apart").select("key", "one.*"), "minhash-pivots")
            pairs = rooted.join(one, "key").filter((F.col("root") != F.col("root_b")) & _may_match("", "_b", near))
            pairs = pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
        else:
            pairs = _pairs(rooted.drop("weight"), heads, near)
        found = _links(pairs, own, near)
        links = found if links is None else links.union(found)
        roots = stash(connected_components(links), "minhash-roots")
        rooted = stash(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-rooted")
    return roots


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(), F.col("doc_id").isNull().alias("_no_id"), F.col("text").cast("string").alias("text"))


def components(docs: DataFrame, near: int = NEAR, empty_alike: bool = False, fingerprints: bool = False) -> tuple[DataFrame, DataFrame]:
    """Each row's prints (KEY, _no_id, node, n), and for sets with several rows or links node, head (the first row's KEY) and size.

    With ``empty_alike`` texts without words are equal; else they are linked with nothing.
    With ``fingerprints`` the links of SimHash are verified first.
    """
    texts = keyed_texts(docs)
    with passing(docs.sparkSession):
        whole = stash(with_prints(texts, fingerprints), "minhash-prints")
        head = F.min(F.struct("_no_id", *KEY)).alias("head")
        heads = whole.filter("n >= 0" if empty_alike else "n > 0").groupBy("node").agg(head, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("signs").alias("signs"))
        heads = stash(heads, "minhash-heads")
        first = stash(fingerprint_pairs(whole.filter("n > 0").select("node", "_fp")), "minhash-first") if fingerprints else None
        roots = similar_roots(heads, texts, near, first)
        members = stash(heads.join(roots, "node", "left").select("node", "head", "copies", F.coalesce("root", "node").alias("root")), "minhash-members")
        least = members.groupBy("root").agg(F.min("head").alias("head"), F.sum("copies").alias("size")).filter("size > 1")
        found = stash(members.select("node", "root").join(least, "root").select("node", "head", "size"), "minhash-found", keep=True)
        prints = stash(whole.select(*KEY, "_no_id", "node", "n"), "minhash-rows", keep=True)
    return prints, found


def near_components(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    prints, found = components(docs, near)
    own, first = (F.when(~F.col(no), F.col(did)) for no, did in (("_no_id", "_did"), ("head._no_id", "head._did")))
    out = prints.join(found, "node", "left").select(own.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("head").isNull(), own).otherwise(first).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


QUERIES = {"op11_minhash": op11_minhash}
ORACLES = {
    "op11_minhash": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM words
), named AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS node, s FROM sets),
nodes AS (SELECT node, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY node),
shingles AS (SELECT node, n, hash(unnest(s)) AS x FROM nodes),
ranked AS (SELECT node, n, x, row_number() OVER (PARTITION BY node ORDER BY f, x) AS k FROM shingles JOIN (SELECT x, count(*) AS f FROM shingles GROUP BY x) USING (x)),
pairs AS (
    SELECT DISTINCT a.node AS a, b.node AS b FROM ranked a JOIN ranked b ON a.x = b.x AND a.node < b.node
    WHERE a.k <= a.n - (85 * a.n + 99) // 100 + 1 AND b.k <= b.n - (85 * b.n + 99) // 100 + 1 AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), links AS (
    SELECT a, b FROM pairs JOIN nodes p ON p.node = a JOIN nodes q ON q.node = b
    WHERE 100 * len(list_intersect(p.s, q.s)) >= 85 * (p.n + q.n - len(list_intersect(p.s, q.s)))
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.b FROM reached r JOIN sides e ON r.b = e.a),
least_ids AS (SELECT r.a AS node, min(d.doc_id) AS component_id FROM reached r JOIN named d ON d.node = r.b AND d.n > 0 GROUP BY r.a)
SELECT d.doc_id, d.n AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM named d LEFT JOIN least_ids l ON l.node = d.node AND d.n > 0
""",
}
