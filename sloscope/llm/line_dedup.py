"""Near-duplicate lines by a segment-partition edit join, in DataFrame and SQL functions only.

Lines within ``EDITS`` edits of each other: cut one into EDITS + 1 segments and at
least one segment stands unchanged in the other, at a place that the lengths bound
(Li, Deng & Feng, 2011). Distinct lines are indexed by (length, segment number,
segment); longer lines probe the indexes of the few lengths below theirs with the
substrings at those places; where different lines meet under a key, their texts are
gathered. Parity signatures of characters and of neighbours, of which an edit changes two
and four bits at most, prune meetings; the rest are compared by a bit-parallel edit distance over a
diagonal band (Hyyrö, 2003) that keeps one machine word a column.

Keys shared by very many lines are cut by the rest of the line: what stands outside the
shared segment is within the same edits, so it is cut into segments and probed as a line is,
level by level, and a short rest meets under what up to EDITS deletions leave of it. Lines
with one common start are so told apart by what follows it. A key that is still large is cut
on the signature (of five parts one is equal for lines in reach), then met chunk by chunk.
Buckets are bounded, give out one verdict a line and never a pair, and lose no link.

A line goes if an earlier one (by doc_id, null last, then rows as read, then place) is
equal, or within EDITS edits where both have LEAST characters or more; shorter lines
only go as exact repeats, and lines without a word never. Earlier lines count even if
they go themselves. A null text has no lines; an empty text has one without a word.
Repeated rows repeat each other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.llm.common import SPACE, stash, table

EDITS = 2
LEAST = 20
#: Lines under one key that are met directly; beyond it the key is cut.
BUCKET = 500
#: Keys (8 bytes each) that may be broadcast; beyond it lines are shuffled to their keys.
BROADCAST_KEYS = 1_000_000
PARTS = 2 * EDITS + 1
#: How often a large key is cut by the rest of its lines; the shortest rest that is cut into segments.
CUTS, SHORTEST = 4, (EDITS + 1) ** 2
_WORD = 64


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _ids(line: str = "line") -> list[Column]:
    """128 bits that stand for a line: the first half joins, both tell equality."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit("line"), F.col(line)).alias("h2")]


def _has_word(line: str = "line") -> Column:
    return F.col(line).rlike(SPACE.replace("[", "[^"))


#: Characters around a segment that hold every place where it may stand in a line in reach.
_MARGIN = (EDITS + 1) ** 2


def segments(less: int, edits: int = EDITS) -> list[tuple[str, str]]:
    """SQL of start (from 0) and size of each segment of a line ``less`` shorter than this one; the last ones take the rest.

    All but the last (length modulo edits + 1) segments have the smaller size.
    """
    parts = edits + 1
    out = []
    for k in range(parts):
        before = f" + greatest(0, {k - parts} + _m{less})" if k > 1 else ""
        more = f" + if(_m{less} >= {parts - k}, 1, 0)" if k else ""
        out.append((f"{k} * _b{less}{before}" if k else "0", f"_b{less}{more}"))
    return out


def measures(edits: int = EDITS) -> list[Column]:
    """Segment size and rest for a line's length ``n`` and those up to ``edits`` below, computed once."""
    return [F.expr(e) for k in range(edits + 1) for e in (f"int((n - {k}) div {edits + 1}) AS _b{k}", f"int((n - {k}) % {edits + 1}) AS _m{k}")]


def regions(edits: int = EDITS) -> list[Column]:
    """The neighbourhood of each of a line's segments, cut out once; finding a place in a string takes a walk to it."""
    own = enumerate(segments(0, edits))
    return [F.expr(e) for k, (start, size) in own for e in (f"greatest(0, {start} - {_MARGIN}) AS _s{k}", f"substring(line, greatest(0, {start} - {_MARGIN}) + 1, {size} + {2 * _MARGIN}) AS _r{k}")]


def _probes(edits: int) -> list[tuple[int, int, int]]:
    """(characters less, segment, shift) of each key of a line, in order."""
    # k edits at most stand left of the first equal segment, edits - k right of it
    return [(less, k, shift) for less in range(edits + 1) for k in range(edits + 1) for shift in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1)]


def line_keys(edits: int = EDITS, least: int = LEAST) -> Column:
    """array<long> of a line's keys (``n`` characters, measures and regions): odd ones for its own segments, even ones
    for substrings that may be a segment of a line of its length or up to ``edits`` shorter, 0 where there is none.

    Lines of ``least`` characters have segments longer than ``edits``, so no substring leaves the line.
    """
    if least < (edits + 1) ** 2:
        raise ValueError("lines are too short for so many edits")
    keys, cuts = [], {less: segments(less, edits) for less in range(edits + 1)}
    for less, k, shift in _probes(edits):
        start, size = cuts[less][k]
        own = int(less == 0 and shift == 0)
        key = f"shiftleft(xxhash64(n - {less}, {k}, substring(_r{k}, {start} + {shift + 1} - _s{k}, {size})), 1) | {own}L"
        keys.append(f"if(n >= {least + less}, {key}, 0L)" if less else key)
    return F.expr(f"array({', '.join(keys)})")


def line_rests(edits: int = EDITS) -> Column:
    """array<string>: for each of a line's keys the line with one character in place of what the key stands for."""
    cuts = {less: segments(less, edits) for less in range(edits + 1)}
    places = [(f"int({cuts[less][k][0]} + {shift})", f"int({cuts[less][k][1]})") for less, k, shift in _probes(edits)]
    return F.expr(f"transform(array({', '.join(f'struct({at} AS a, {size} AS s)' for at, size in places)}), p -> concat(substring(line, 1, p.a), '\\u0001', substring(line, p.a + p.s + 1)))")


def deletions(edits: int = EDITS) -> Column:
    """array<string>: what is left of the short string ``line`` after up to ``edits`` deletions."""
    left = "array(line)"
    for _ in range(edits):
        each = "transform(sequence(1, greatest(1, length(v))), i -> concat(substring(v, 1, i - 1), substring(v, i + 1)))"
        left = f"array_distinct(concat({left}, flatten(transform({left}, v -> {each}))))"
    return F.expr(left)


#: Parities of the counts of characters and of pairs of neighbours, each dealt to 64 bits.
SIGNATURE = "aggregate(chars, 0L, (a, c) -> a ^ shiftleft(1L, ascii(c) & 63))"
PAIR_SIGNATURE = "aggregate(chars, struct(0L AS s, 0 AS before), (a, c) -> struct(a.s ^ shiftleft(1L, (31 * a.before + ascii(c)) & 63) AS s, ascii(c) AS before), a -> a.s)"


def banded_distance(longer: str, shorter: str, edits: int = EDITS) -> str:
    """SQL for the edit distance of two arrays of characters, exact up to ``edits`` and larger beyond.

    Column i of the table, one for each character of ``shorter``, keeps the rows
    i - edits .. i + edits as vertical steps +1 (vp) and -1 (vn) in one word; ``d``
    follows the band's lowest row, along the diagonal and then up the last column.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    matches = " | ".join(f"if(get({longer}, i - {edits - b}) <=> c, {1 << b}L, 0L)" for b in range(width))
    d0 = f"((((((x.m & s.vp) + s.vp) ^ s.vp) | x.m | s.vn)) & {full}L)"
    hp = f"(s.vn | ({full}L & ~({d0} | s.vp)))"
    last = f"(x.i - (size({longer}) - {edits}))"
    bit = f"shiftleft(1L, {width - 2} - {last})"
    step = f"""if({last} < 0, if(({d0} & {1 << (width - 1)}L) = 0L, 1, 0),
        if(({hp} & {bit}) <> 0L, 1, 0) - if(({d0} & s.vp & {bit}) <> 0L, 1, 0))"""
    return f"""aggregate(
        transform({shorter}, (c, i) -> struct({matches} AS m, i AS i)),
        struct({full & full << edits}L AS vp, 0L AS vn, {edits} AS d),
        (s, x) -> struct(
            ({d0} & s.vp) | ({full}L & ~(shiftright({d0}, 1) | {hp})) AS vp,
            shiftright({d0}, 1) & {hp} AS vn,
            s.d + {step} AS d),
        s -> s.d)"""


def line_table(rows: DataFrame) -> DataFrame:
    """Every line of every row (rid, doc_id, text) without its text: pos, n, h, h2, worded, keys; written once.

    A null text has one row without pos; keys are null for lines that can be near no other.
    """
    # the length comes out of the generator, else every use of it would count characters again
    split = F.expr("transform(split(text, '\\n', -1), (x, i) -> struct(i AS pos, x AS line, length(x) AS n))")
    lines = rows.select("rid", "doc_id", F.inline_outer(split)).select("*", *measures())
    lines = lines.select("*", F.coalesce(_has_word(), F.lit(False)).alias("worded"), *regions())
    keys = F.when((F.col("n") >= LEAST) & F.col("worded"), line_keys()).alias("keys")
    return stash(lines.select("rid", "doc_id", "pos", "n", *_ids(), "worded", keys), "lines-rows")


def _keyed(lines: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, key, its place in the line's keys and indexed, for each key of the lines that have any; equal lines repeat."""
    each = lines.filter("keys IS NOT NULL").select(*carried, F.posexplode("keys").alias("place", "_key")).filter("_key <> 0")
    return each.withColumns({"key": F.shiftright("_key", 1), "indexed": F.col("_key").bitwiseAND(F.lit(1))}).drop("_key")


def shared_keys(lines: DataFrame) -> DataFrame:
    """Keys under which different lines meet, one of them by a segment of its own.

    Key and line hashes alone are shuffled, summed on the map side: a line repeated
    any number of times, or a key's many lines, are one row a task.
    """
    met = _keyed(lines, "h").groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("indexed").alias("indexed"))
    return met.filter("a <> b AND indexed = 1").select("key")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, h2, line and its signatures for the ``wanted`` lines (h, h2)."""
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    lines = rows.select(F.explode(F.split("text", "\n", -1)).alias("line")).select("line", *_ids()).join(wanted, ["h", "h2"], "left_semi")
    once = lines.groupBy("h", "h2", "line").agg(F.count("*").alias("_n")).select("h", "h2", "line", F.split("line", "").alias("chars"))
    return once.select("h", "h2", "line", F.expr(SIGNATURE).alias("sig"), F.expr(PAIR_SIGNATURE).alias("pairs"))


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (key, h, h2, line) of large keys under finer ones (key, h, h2, line, indexed); ``line`` is what no key stands for yet.

    Two rests within EDITS share a segment as lines do; if one is shorter than SHORTEST,
    both are at most EDITS longer and share what some deletions leave of them.
    """
    sized = rows.withColumn("n", F.length("line"))
    long = sized.filter(F.col("n") >= SHORTEST).select("*", *measures()).select("*", *regions())
    long = long.select("key", "h", "h2", F.inline(F.arrays_zip(line_keys(EDITS, SHORTEST).alias("sub"), line_rests().alias("rest")))).filter("sub <> 0")
    long = long.select(F.xxhash64("key", F.shiftright("sub", 1)).alias("key"), "h", "h2", F.col("rest").alias("line"), F.col("sub").bitwiseAND(F.lit(1)).alias("indexed"))
    short = sized.filter(F.col("n") < SHORTEST + EDITS).select("key", "h", "h2", F.explode(deletions()).alias("left"))
    short = short.select(F.xxhash64("key", F.lit("short"), "left").alias("key"), "h", "h2", F.lit("").alias("line"), F.lit(1).cast("long").alias("indexed"))
    return long.union(short).distinct()


def _fine_keys(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, h, h2) of keys with up to BUCKET lines, and of those that remain larger however they are cut."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    sized = members.join(stash(sizes, "lines-sizes"), "key")
    small = sized.filter(F.col("size") <= BUCKET).select("key", "h", "h2")
    large = stash(sized.filter(F.col("size") > BUCKET).drop("size"), "lines-large")
    if large.isEmpty():
        return small, large.select("key", "h", "h2")
    place = F.element_at(line_rests(), F.col("place") + 1)
    lines = large.join(texts.select("h", "h2", "line"), ["h", "h2"]).select("*", *measures())
    rows, ended = lines.select("key", "h", "h2", place.alias("line")), []
    for cut in range(CUTS):
        finer = stash(_cut(rows), "lines-finer")
        # indexed or not: a key under which no line has a segment of its own joins nothing
        sizes = finer.groupBy("key").agg(F.count("*").alias("size"), F.min("h").alias("a"), F.max("h").alias("b"), F.max("indexed").alias("any")).filter("a <> b AND any = 1").select("key", "size")
        finer = stash(finer.join(stash(sizes, "lines-sizes"), "key"), "lines-sized")
        small = small.union(finer.filter(F.col("size") <= BUCKET).select("key", "h", "h2"))
        ended.append(finer.filter((F.col("size") > BUCKET) & (F.col("line") == "")).select("key", "h", "h2"))
        rows = stash(finer.filter((F.col("size") > BUCKET) & (F.col("line") != "")).select("key", "h", "h2", "line"), "lines-large")
        if rows.isEmpty():
            break
    for part in ended:
        rows = rows.select("key", "h", "h2").union(part)
    return small.distinct(), rows.select("key", "h", "h2").distinct()


def _cells(small: DataFrame, large: DataFrame) -> DataFrame:
    """Rows with ``sig`` of buckets that can be met whole, keyed by (key, part, piece, cell).

    A key that is still large is cut by pieces of the signature, of which lines in reach
    share one; a piece still too large is dealt into chunks, each of which meets each other
    one in a cell of two.
    """
    zero = F.lit(0).cast("long")
    small = small.select("*", zero.alias("part"), zero.alias("piece"), F.lit(0).alias("cell"))
    width = -(-_WORD // PARTS)
    pieces = F.array(*[F.struct(F.lit(k).cast("long").alias("part"), F.shiftrightunsigned("sig", k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("piece")) for k in range(PARTS)])
    parted = large.select("*", F.inline(pieces))
    again = parted.groupBy("key", "part", "piece").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("chunks"))
    dealt = parted.join(again, ["key", "part", "piece"]).withColumn("chunk", F.pmod("h2", "chunks").cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(k, F.col("chunk")) * F.col("chunks") + F.greatest(k, F.col("chunk")))
    return small.unionByName(dealt.withColumn("cell", F.explode(cells)).drop("chunks", "chunk"))


def near_lines(rows: DataFrame, lines: DataFrame, first: DataFrame) -> DataFrame:
    """h, h2 of the lines that have an earlier one within EDITS; ``first`` has each line's first place.

    Lines are met inside their bucket, and a line's verdict is all that leaves it.
    """
    alive = stash(shared_keys(lines), "lines-keys")
    if alive.count() <= BROADCAST_KEYS:
        alive = F.broadcast(alive)
    members = stash(_keyed(lines, "h", "h2", "n").join(alive, "key", "left_semi").select("key", "h", "h2", "n", "place").distinct(), "lines-members")
    texts = stash(_texts(rows, stash(members.select("h", "h2").distinct(), "lines-wanted")), "lines-texts")
    told = texts.join(first.select("h", "h2", "first"), ["h", "h2"]).withColumn("n", F.length("line"))
    small, large = (part.join(told, ["h", "h2"]) for part in _fine_keys(members, texts))
    one = F.struct("first", "n", "sig", "pairs", "h", "h2", F.split("line", "").alias("chars"))
    met = _cells(small, large).groupBy("key", "part", "piece", "cell").agg(F.array_sort(F.collect_set(one)).alias("bucket")).filter(F.size("bucket") > 1)
    reach = f"q.first < p.first AND abs(q.n - p.n) <= {EDITS} AND bit_count(q.sig ^ p.sig) <= {2 * EDITS} AND bit_count(q.pairs ^ p.pairs) <= {4 * EDITS}"
    close = f"if(q.n >= p.n, {banded_distance('q.chars', 'p.chars')}, {banded_distance('p.chars', 'q.chars')}) <= {EDITS}"
    near = F.expr(f"transform(filter(bucket, p -> exists(bucket, q -> {reach} AND {close})), p -> struct(p.h AS h, p.h2 AS h2))")
    return met.select(F.inline(near)).distinct()


def judged_lines(rows: DataFrame) -> DataFrame:
    """For every line of every row (rid, doc_id, text): pos, whether it has a word, whether it goes; a null text has one row without pos."""
    lines = line_table(rows)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "pos")
    first = stash(lines.filter("worded").groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "lines-first")
    close = near_lines(rows, lines, first).withColumn("near", F.lit(True))
    known = first.join(close, ["h", "h2"], "left").filter("copies > 1 OR near").select("h", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    again = F.coalesce(F.col("near") | (F.col("first.rid") != F.col("rid")) | (F.col("first.pos") != F.col("pos")), F.lit(False))
    return lines.join(known, ["h", "h2"], "left").select("rid", "doc_id", "pos", "worded", (again & F.col("worded")).alias("goes"), (F.coalesce("near", F.lit(False)) & F.col("worded")).alias("near"))


def removed_lines(rows: DataFrame) -> DataFrame:
    """One row per row (rid, doc_id, text): line counts and the places of the lines that go, from 0."""
    gone = F.array_sort(F.collect_list(F.when(F.col("goes"), F.col("pos"))))
    return judged_lines(rows).groupBy("rid", "doc_id").agg(F.count("pos").alias("n_lines"), F.count_if("goes").alias("n_removed"), F.count_if("near").alias("n_near"), gone.alias("removed"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that go, other columns as they came; a null text stays null."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = stash(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole), "lines-docs")
    gone = removed_lines(rows.select("rid", "doc_id", "text")).filter("n_removed > 0").select("rid", "removed")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("_row.text"))
    return rows.join(gone, "rid", "left").select(*[(text if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = removed_lines(_numbered(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_lines", "n_removed", "n_near", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES: dict[str, str] = {}
