r"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Fixed forms (email, ip, card, phone) are found first. Then every value that holds a digit
makes an edge between an instance (the value) and each of its lexical patterns: the word
before it and the two words before it, each with the separator (``=``, ``:``, ``#``, a
line's end or none); the word may stand in quotes, as keys do. Values of a fixed form, or shaped like a secret, are the seeds; scores pass over
the graph a few times: a pattern's confidence is its instances' mean score, an
instance's score its best pattern's confidence. Patterns of high confidence and enough
distinct seeds then mark every value that they introduce, whatever it looks like, as a
span of kind ``id``.

All regular expressions loop over single character classes, so no text overflows the
stack, and places are summed block by block: a text of twice the length or with twice
the matches takes about twice the time. For that a text is first rewritten character by
character: a full stop that no domain character follows becomes ``_`` for emails (the
local part takes both), a separator not between digits becomes ``x`` for cards.

Defined cases: a null text counts as empty and has no spans. Offsets are code points,
ends exclusive. Spans of one kind never overlap; an ``id`` never overlaps a fixed
form. Repeated rows and null ids get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.llm.common import KEY, row_key, stash, table, text_or_empty, whole_row

KINDS = ("email", "ip", "card", "phone")
#: Found spans are ordered by these, then by start.
FOUND = (*KINDS, "id")

LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{DOMAIN}]++\.[.{DOMAIN}]++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: The form of a value behind its words: a phone or a card, perhaps with spaces, or six characters or more with a digit.
VALUE = r"\+[0-9][\x20().0-9-]{6,20}[0-9]|[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9])|(?=[^\x00-\x20]{0,63}[0-9])[^\x00-\x20\x22'<>|,;]{6,}+"
_WORD = r"\p{L}[\p{L}0-9_]{0,31}+"
#: Perhaps a word, a word, perhaps a quote and a bracket, a separator (a line may end behind it), a line's end or a space, perhaps a quote, and a value.
_BETWEEN = r"[\x20\t]{0,3}([:=#])[\x20\t\r\n]{0,3}|[.,]?[\x20\t]{0,3}(\r?\n)[\x20\t]{0,3}|[.,]?[\x20\t]{1,3}"
CONTEXT = rf"(?<![\p{{L}}0-9_])(?:({_WORD})[\x20\t]{{1,3}})?({_WORD})[\x22'\]]{{0,2}}(?:{_BETWEEN})[\x22'(]?({VALUE})"
SECRET = r"^(?:[0-9a-fA-F]{32,}|(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=-]{24,})$"

ROUNDS, SEEDS, CONFIDENCE = 3, 3, 0.7
#: Rows and spans (some 250 bytes each) that may be broadcast; beyond it rows are shuffled to their spans.
BROADCAST_SPANS = 200_000


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` stands for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Elements whose running values are appended one by one.
_BLOCK = 128


def running(values: str, more: str, zero: str = "0L") -> str:
    """SQL for the running values of the array<bigint> ``values`` under ``more`` (of a_ and b_), in time near its length."""
    last = f"coalesce(try_element_at(s_, -1), {zero})"
    scan = f"aggregate(k_, CAST(array() AS array<bigint>), (s_, b_) -> concat(s_, array({let(last, 'a_', more)})))"
    blocks = f"transform(sequence(0, greatest(0, (size(v_) - 1) div {_BLOCK})), j_ -> slice(v_, int(j_ * {_BLOCK} + 1), {_BLOCK}))"
    base = f"aggregate(c_, array({zero}), (s_, x_) -> concat(s_, array({let('element_at(s_, -1)', 'a_', let(f'coalesce(try_element_at(x_, -1), {zero})', 'b_', more))})))"
    joined = f"flatten(transform(c_, (x_, i_) -> transform(x_, b_ -> {let('element_at(d_, i_ + 1)', 'a_', more)})))"
    return let(values, "v_", let(f"transform({blocks}, k_ -> {scan})", "c_", let(base, "d_", joined)))


def matches(text: str, pattern: str) -> str:
    """SQL for array<struct<s, m>>: the start and text of each match of ``pattern`` in the SQL value ``text``."""
    p = _quoted(pattern)
    widths = "transform(m_, (y_, n_) -> bigint(length(get(g_, n_)) + length(y_)))"
    placed = "transform(m_, (y_, n_) -> struct(element_at(e_, n_ + 1) - length(y_) AS s, y_ AS m))"
    return let(f"split({text}, '{p}', -1)", "g_", let(f"regexp_extract_all({text}, '{p}', 0)", "m_", let(running(widths, "a_ + b_"), "e_", placed)))


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


#: Luhn's sum over the digits, from the right.
_LUHN = """aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr(d, length(d) + 1 - i, 1))
    ELSE int(substr(d, length(d) + 1 - i, 1)) * 2 - if(substr(d, length(d) + 1 - i, 1) >= '5', 9, 0) END) % 10 = 0"""

_NO_MATCH = "CAST(array() AS array<struct<s: bigint, m: string>>)"
_NO_SPAN = "CAST(array() AS array<struct<s: bigint, e: bigint>>)"


def fixed_spans(text: str) -> dict[str, Column]:
    """For each kind, array<struct<s, m>> of its matches in the column ``text``; failing matches are dropped."""
    dots = f"regexp_replace({text}, '\\\\.(?![{DOMAIN}])', '_')"
    seps = f"regexp_replace({text}, '(?<![0-9])[\\\\x20-]|[\\\\x20-](?![0-9])', 'x')"
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    return {
        "email": F.expr(f"if(contains({text}, '@'), transform({matches(dots, EMAIL)}, x -> struct(x.s AS s, x.m AS m)), {_NO_MATCH})"),
        "ip": F.expr(f"if({text} RLIKE '[0-9]\\\\.[0-9]', filter({matches(text, IP)}, x -> x.m RLIKE '^{_quoted(OCTET)}(?:\\\\.{_quoted(OCTET)}){{3}}$'), {_NO_MATCH})"),
        "card": F.expr(
            f"if({text} RLIKE '[0-9](?:[\\\\x20-]?[0-9]){{15}}', filter({matches(seps, CARD)}, x -> length({digits}) BETWEEN 16 AND 19 "
            f"AND exists(array({digits}), d -> {_LUHN})), {_NO_MATCH})"
        ),
        "phone": F.expr(f"if(contains({text}, '+'), filter({matches(text, PHONE)}, x -> length({digits}) BETWEEN 8 AND 15), {_NO_MATCH})"),
    }


def _scanned(docs: DataFrame) -> DataFrame:
    """For each key of rows that have any: the fixed spans by kind, and the values in context (patterns, s, value)."""
    rows = docs.select(*row_key(), text_or_empty().alias("text"))
    seen = F.expr(f"if(text RLIKE '[0-9]', {matches('text', CONTEXT)}, {_NO_MATCH})")
    part = lambda k: f"coalesce(regexp_extract(x.m, '{_quoted(CONTEXT)}', {k}), '')"
    sign = f"concat({part(3)}, if({part(4)} = '', '', '|'))"  # a word at a line's end is a pattern of its own
    tidy = F.expr(
        f"""transform(seen, x -> struct(
            transform(filter(array(concat({part(2)}, {sign}), if({part(1)} = '', '', concat({part(1)}, ' ', {part(2)}, {sign}))), p -> p <> ''), p -> lower(p)) AS patterns,
            x.s + length(x.m) - length({part(5)}) AS s, regexp_replace({part(5)}, '[^\\\\p{{L}}0-9]+$', '') AS value))"""
    )
    rows = rows.select(*KEY, *(e.alias(k) for k, e in fixed_spans("text").items()), seen.alias("seen"))
    bounds = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"))).alias(k) for k in KINDS]
    rows = rows.select(*KEY, *bounds, F.filter(tidy, lambda x: (F.length(x["value"]) >= 6) & x["value"].rlike("[0-9]")).alias("seen"))
    return rows.filter(sum((F.size(k) for k in (*KINDS, "seen")), F.lit(0)) > 0)


def _is_seed(value: str) -> str:
    forms = "|".join((rf"[{LOCAL}]+@[{DOMAIN}]+\.[.{DOMAIN}]*[{DOMAIN}]", rf"{OCTET}(?:\.{OCTET}){{3}}", r"[0-9](?:[\x20-]?[0-9]){15,18}", r"\+[0-9][\x20().0-9-]{6,20}[0-9]"))
    return f"({value} RLIKE '^(?:{_quoted(forms)})$' OR {value} RLIKE '{_quoted(SECRET)}')"


def trusted_patterns(occurrences: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """Patterns (label and separator) worth trusting, from all occurrences (pattern, value) of the corpus."""
    graph = stash(occurrences.groupBy("pattern", "value").agg(F.count("*").alias("n")).withColumn("seed", F.expr(f"if({_is_seed('value')}, 1.0D, 0.0D)")), "pii-graph")
    support = F.sum("seed").alias("seeds")
    patterns = graph.groupBy("pattern").agg(F.avg("seed").alias("confidence"), support)
    for _ in range(rounds - 1):
        best = graph.join(patterns.filter("seeds > 0"), "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        scored = graph.join(best, "value", "left").withColumn("score", F.greatest("seed", F.coalesce("best", F.lit(0.0))))
        patterns = scored.groupBy("pattern").agg(F.avg("score").alias("confidence"), support)
        patterns = stash(patterns, "pii-patterns")
    return patterns.filter((F.col("seeds") >= seeds) & (F.col("confidence") >= confidence)).select("pattern")


def _clear(ids: str, fixed: str) -> Column:
    """SQL column of the ``ids`` (s, e) that overlap none of the ``fixed`` spans: the furthest end among those that start before an id's end is known in order of place."""
    events = f"""array_sort(concat(transform({fixed}, f -> struct(f.s AS p, 0 AS kind, f.e AS e, f.s AS s)),
        transform({ids}, f -> struct(f.e AS p, -1 AS kind, f.e AS e, f.s AS s))))"""
    ends = "transform(w_, f -> if(f.kind = 0, f.e, 0L))"
    kept = "transform(filter(transform(w_, (f, n_) -> struct(f.kind AS kind, f.s AS s, f.e AS e, element_at(e_, n_ + 1) AS far)), f -> f.kind = -1 AND f.far <= f.s), f -> struct(f.s AS s, f.e AS e))"
    return F.expr(let(events, "w_", let(running(ends, "greatest(a_, b_)"), "e_", f"array_sort({kept})")))


def _spans_by_key(docs: DataFrame) -> DataFrame:
    """One row for each key with any span: array<struct<s, e>> in order for each kind of FOUND."""
    scanned = stash(_scanned(docs), "pii-scanned")
    seen = scanned.select(*KEY, F.explode("seen").alias("x")).select(*KEY, "x.s", "x.value", F.explode("x.patterns").alias("pattern"))
    trusted = stash(trusted_patterns(seen.select("pattern", "value")), "pii-trusted")
    # rows of one key are alike, so any of them speaks for it
    spans = scanned.groupBy(*KEY).agg(F.first(F.struct(*KINDS)).alias("x")).select(*KEY, "x.*")
    found = seen.join(trusted, "pattern").select(*KEY, "s", (F.col("s") + F.length("value")).alias("e")).distinct()
    ids = found.groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("ids"))
    spans = spans.join(ids, list(KEY), "left").withColumn("ids", F.coalesce("ids", F.expr(_NO_SPAN)))
    clear = F.when(F.size("ids") > 0, _clear("ids", "flatten(array(email, ip, card, phone))")).otherwise(F.expr(_NO_SPAN))
    spans = spans.select(*KEY, *KINDS, clear.alias("id"))
    return stash(spans.filter(sum((F.size(k) for k in FOUND), F.lit(0)) > 0), "pii-spans")


def found_spans(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, and ``email`` to ``id``: array<struct<s, e>> in order for each kind of FOUND."""
    spans = _spans_by_key(docs)
    held = spans.agg(F.count("*") + F.coalesce(F.sum(sum((F.size(k) for k in FOUND), F.lit(0))), F.lit(0))).first()[0]
    if held <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    rows = docs.select(whole_row(docs), *row_key()).join(spans, list(KEY), "left")
    none = F.expr(_NO_SPAN)
    return rows.select(F.col("_row").alias("row"), *(F.coalesce(k, none).alias(k) for k in FOUND))


def spelled(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind and start, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    return F.array_join(F.flatten(F.array(*map(of, kinds))), ",")


#: Characters of a text that are cut out together.
_CUT = 1024


def redacted(text: str = "row.text") -> Column:
    """The text with each stretch of overlapping spans replaced by its first span's kind, like ``[EMAIL]``."""
    spans = ", ".join(f"transform({k}, f -> struct(f.s AS s, f.e AS e, '[{k.upper()}]' AS k))" for k in FOUND)

    def piece(a: str, b: str) -> str:
        """Characters a up to b, from the blocks that hold them."""
        return f"substring(array_join(slice(t_, int({a} div {_CUT} + 1), int(greatest({a}, {b} - 1) div {_CUT} - {a} div {_CUT} + 1)), ''), int({a} % {_CUT} + 1), int({b} - {a}))"

    before = "if(n_ = 0, 0L, element_at(e_, greatest(n_, 1)))"
    heads = f"filter(transform(w_, (f, n_) -> struct({before} AS a, f.s AS b, f.k AS k)), h -> h.b >= h.a)"
    cut = f"concat(array_join(transform({heads}, h -> concat({piece('h.a', 'h.b')}, h.k)), ''), {piece('element_at(e_, -1)', f'bigint(length({text}))')})"
    blocks = f"regexp_extract_all({text}, '(?s).{{1,{_CUT}}}', 0)"
    return F.expr(let(f"array_sort(flatten(array({spans})))", "w_", let(running("transform(w_, f -> f.e)", "greatest(a_, b_)"), "e_", let(blocks, "t_", cut))))


def _with_text(docs: DataFrame) -> DataFrame:
    """``found_spans`` and the redacted text, null where there is nothing to redact."""
    some = sum((F.size(k) for k in FOUND), F.lit(0)) > 0
    return found_spans(docs).withColumn("new", F.when(some, redacted()))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` (and ``n_chars`` kept in step); rows without any stay as they are."""
    row = {c: F.col("row")[c] for c in docs.columns}
    row["text"] = F.coalesce("new", row["text"])
    if "n_chars" in row:
        row["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return _with_text(docs).select(*[column.alias(c) for c, column in row.items()])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and the redacted text."""
    found = _with_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("row.doc_id", *counts, F.sha2(spelled(KINDS), 256).alias("base_sha256"), spelled(FOUND).alias("spans"), F.coalesce("new", "row.text").alias("text"))


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
