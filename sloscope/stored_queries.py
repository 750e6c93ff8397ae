"""Registered queries over the store: what ``queries`` asks of events, asked of roll-ups and kept tables.

The events are dealt into batches against their order, each written as a batch of a store
by the query itself, so its work grows with the table; no query reads the events again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.functions import scalars as S
from sloscope.operators import anomaly, buckets, detectors, quantiles, slo, windows
from sloscope.queries import (
    _FRAMES, _NAMED, _STEP, ALERTS_SQL, COUNTS, FOUND_SQL, LIMITS_SQL, ORACLES, SEVERITY_SQL, TIERS_SQL, Z_SQL, _limits, _pick, _stream, burn_sql, last_minute, load, objectives, query, rounded, slo_sql, spelt, window_sql,
)
from sloscope.scratch import shared_folder
from sloscope.streaming import burning, pipeline, store

BATCHES = 3


def stored(spark: SparkSession, d: str) -> tuple[str, int | None, DataFrame]:
    """A store of the events in BATCHES batches, its last minute, and the events."""
    home, rows = shared_folder(spark, "store"), load(spark, d)
    for n in range(BATCHES):
        store.write_store(rows.filter(F.col("arrival_seq") % BATCHES == n), n, home)
    return home, store.catalogue(spark, home).agg(F.max("last_minute")).first()[0], rows


# --- windows ------------------------------------------------------------------------------


def _stored_window(name: str, window: str, minutes: int) -> None:
    @query(name, window_sql(minutes).replace("quantile_cont", "quantile_disc"))
    def _(spark, d):
        """Counters from the levels; the quantile is a value of the window, selected from its stored latencies."""
        home, at, _ = stored(spark, d)
        return rounded(spelt(store.stored_window(spark, home, window, 0.95, at, exact=True)))


_stored_window("stored_window_5m", "5m", 5)
_stored_window("stored_window_1d", "1d", 1440)


@query("stored_window_30d", window_sql(43200).replace("round(lq, 6) AS latency_quantile_ms", "true AS rank_in_bounds"))
def _(spark, d):
    """Thirty days from the fewest whole blocks; the quantile's rank is held against the events'."""
    home, at, rows = stored(spark, d)
    found = store.stored_window(spark, home, "30d", 0.95, at)
    inside = windows.in_window(buckets.with_series(rows).select("series", "minute", S.finite("latency_ms").alias("v")), 43200, at)
    met = inside.join(F.broadcast(found.select("series", "latency_quantile_ms")), "series")
    share = lambda c: F.avg(c.cast("double"))
    ranks = met.groupBy("series").agg(share(F.col("v") < F.col("latency_quantile_ms")).alias("low"), share(F.col("v") <= F.col("latency_quantile_ms")).alias("high"))
    near = (F.col("low") <= 0.955) & (F.col("high") >= 0.945)
    return rounded(spelt(found.drop("latency_quantile_ms").join(ranks.select("series", near.alias("rank_in_bounds")), "series", "left")))


@query("quantile_by_passes", " UNION ALL ".join(f"SELECT series, {q}::DOUBLE AS q, count(v) AS n, round(quantile_cont(v, {q}), 6) AS quantile FROM ev GROUP BY series" for q in (0.5, 0.95, 0.999)))
def _(spark, d):
    """Exact quantiles of whole series, none gathered beyond a thousand values."""
    values = buckets.with_series(load(spark, d)).select("series", S.finite("latency_ms").alias("v"))
    parts = [quantiles.exact_quantile(values, q, 1000).withColumn("q", F.lit(q)) for q in (0.5, 0.95, 0.999)]
    return rounded(spelt(parts[0].union(parts[1]).union(parts[2])))


# --- objectives ---------------------------------------------------------------------------


def _stored_evaluation(name: str, like: str, kind: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        home, at, _ = stored(spark, d)
        out = slo.evaluation_of(store.stored_budgets(spark, home, objectives(spark, kind), as_of_minute=at))
        return rounded(out.withColumns({"tiers": F.array_join(F.col("alerts.tier_label"), ","), "alerts": F.size("alerts").cast("long")}))

    query(name)(run)
    ORACLES[name] = ORACLES[like]


_stored_evaluation("stored_slo_evaluation", "slo_evaluation", "availability")
_stored_evaluation("stored_latency_slo", "latency_slo", "latency")
_stored_evaluation("stored_missing_slo", "missing_model_slo", "missing")


@query("stored_slo_alerts", slo_sql("availability") + f", {ALERTS_SQL} SELECT slo, tier_no, tier_label, severity, round(long_burn_rate, 6) AS long_burn_rate, round(short_burn_rate, 6) AS short_burn_rate, long_total, short_total FROM alerts")
def _(spark, d):
    home, at, _ = stored(spark, d)
    return rounded(slo.flat_alerts(store.stored_budgets(spark, home, objectives(spark), as_of_minute=at)))


CUSTOM_TIERS = ((1, 2.0, 360, 60, "page", "six-hours"), (2, 1.2, 4320, 30, "ticket", "three-days"), (3, 50.0, 60, 5, "page", "never"))
_CUSTOM_SQL = "(VALUES " + ", ".join(f"({n}, '{label}', '{severity}', {rate}::DOUBLE, {a}, {b})" for n, rate, a, b, severity, label in CUSTOM_TIERS) + ") AS tiers(tier_no, tier_label, severity, rate, lw, sw)"


@query("stored_custom_tiers", slo_sql("availability") + f", {ALERTS_SQL.replace(TIERS_SQL, _CUSTOM_SQL)} SELECT slo, tier_no, tier_label, severity, round(long_burn_rate, 6) AS long_burn_rate, round(short_burn_rate, 6) AS short_burn_rate, long_total, short_total FROM alerts")
def _(spark, d):
    """Tiers of a user's own: other windows, rates and names."""
    home, at, _ = stored(spark, d)
    return rounded(slo.flat_alerts(store.stored_budgets(spark, home, objectives(spark), CUSTOM_TIERS, at), CUSTOM_TIERS))


@query("latest_evaluation", slo_sql("availability") + f" SELECT slo, objective, round({burn_sql('60')}, 6) AS burn_rate_1h, round({burn_sql('full')}, 6) AS burn_rate_full_window FROM sums")
def _(spark, d):
    """What the periodic evaluation of a store has kept last; an evaluation of an earlier minute stands before it."""
    home, at, _ = stored(spark, d)
    keep = pipeline.evaluations(spark, f"{home}/evaluations")
    for n, minute in enumerate((at - 5000, at)):
        found = slo.evaluation_of(store.stored_budgets(spark, home, objectives(spark), as_of_minute=minute))
        keep.put(found.withColumn("evaluated_at", F.current_timestamp()), "periodic", n)
    return rounded(pipeline.latest_evaluation(spark, f"{home}/evaluations").select("slo", "objective", "burn_rate_1h", "burn_rate_full_window"))


@query("compacted_buckets", f"SELECT series, minute, {COUNTS}, 1::BIGINT AS parts FROM ev GROUP BY ALL")
def _(spark, d):
    """The minutes of a store after compaction: as many events as before, and one part a day."""
    home, at, _ = stored(spark, d)
    store.compact(spark, home)
    rows = store.reader(spark, home)("minute", [(0, at)])
    parts = rows.groupBy("series", "minute").agg(*[F.sum(c).alias(c) for c in buckets.COUNTERS], F.count("*").alias("parts"))
    return spelt(parts)


# --- streams ------------------------------------------------------------------------------


@query("serve_anomalies", Z_SQL + f", {FOUND_SQL}, {LIMITS_SQL} SELECT * FROM found UNION ALL SELECT * FROM limits", recursive=True)
def _(spark, d):
    """Every anomaly of a served stream, scored by chunks from the states that the batches before have left."""
    home = shared_folder(spark, "serve")
    known = anomaly.detectors_for(objectives(spark)).unionByName(anomaly.detector_table(spark, _limits()))
    for running in pipeline.serve(_stream(spark, d), known, home, shared_folder(spark, "stream-checkpoint")):
        running.awaitTermination()
    return rounded(pipeline.all_anomalies(spark, home))


@query("serve_windows", window_sql(1440).replace("quantile_cont", "quantile_disc"))
def _(spark, d):
    """The store that a served stream has written, asked for a day."""
    home = shared_folder(spark, "serve")
    for running in pipeline.serve(_stream(spark, d), anomaly.detector_table(spark, _limits()), home, shared_folder(spark, "stream-checkpoint")):
        running.awaitTermination()
    known = store.catalogue(spark, f"{home}/store")
    return rounded(spelt(store.stored_window(spark, f"{home}/store", "1d", 0.95, known.agg(F.max("last_minute")).first()[0], exact=True)))


@query(
    "serve_series_cap",
    """--cte first AS (SELECT regional, min(seq) AS opened FROM ev GROUP BY 1), ok AS (SELECT regional FROM first ORDER BY opened LIMIT 10)
    SELECT regional AS series, count(*) AS n, (SELECT count(*) FROM ev WHERE regional NOT IN (SELECT regional FROM ok)) AS refused FROM ev WHERE regional IN (SELECT regional FROM ok) GROUP BY 1""",
)
def _(spark, d):
    """A store whose stream admits ten series in all, and what it has refused."""
    home, rows = shared_folder(spark, "serve"), load(spark, d, True)
    middle = rows.agg(F.percentile_approx("arrival_seq", 0.5)).first()[0]
    for n, part in enumerate((rows.filter(F.col("arrival_seq") <= middle), rows.filter(F.col("arrival_seq") > middle))):
        store.write_store(pipeline.admit(part, n, home, 10), n, f"{home}/store")
    refused = pipeline.refused_events(spark, home).agg(F.sum("refused")).first()[0]
    parts = buckets.with_totals(store.reader(spark, f"{home}/store")("day", [(0, last_minute(rows))]))
    return spelt(parts.groupBy("series").agg(F.sum("total").alias("n"))).withColumn("refused", F.lit(refused).cast("long"))


@query(
    "stream_slo_timeline",
    slo_sql("availability") + f""", ends AS (SELECT slo, (min(minute) + {_STEP - 1}) // {_STEP} AS a, (SELECT (m - 1) // {_STEP} FROM edge) AS b FROM s GROUP BY slo),
    spine AS (SELECT slo, unnest(range(a, b + 1)) * {_STEP} AS minute FROM ends),
    every AS (SELECT slo, minute, total, bad, false AS spine FROM s UNION ALL SELECT slo, minute, 0, 0, true FROM spine),
    rolled AS (SELECT slo, minute, spine, 0.9::DOUBLE AS objective, {_FRAMES} FROM every WINDOW {_NAMED}),
    tiered AS (SELECT slo, minute, tier_no, tier_label, rate, {_pick(burn_sql, "lw")} AS l, {_pick(burn_sql, "sw")} AS s FROM rolled, {TIERS_SQL} WHERE spine)
    SELECT slo, minute, tier_no, tier_label, round(l, 6) AS long_burn_rate, round(s, 6) AS short_burn_rate, l >= rate AND s >= rate AS fires FROM tiered""",
)
def _(spark, d):
    """Alerts kept up by a stream of three files in the order of time: every minute that the watermark has passed."""
    rows = load(spark, d)
    files, found = shared_folder(spark, "events-by-time"), shared_folder(spark, "stream-burning")
    cuts = rows.agg(F.percentile_approx("ts_nanos", [0.33, 0.67])).first()[0]
    for inside in (F.col("ts_nanos") <= cuts[0], (F.col("ts_nanos") > cuts[0]) & (F.col("ts_nanos") <= cuts[1]), F.col("ts_nanos") > cuts[1]):
        rows.filter(inside).coalesce(1).write.mode("append").parquet(files)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(files)
    burning.write_burning(stream, objectives(spark), found, shared_folder(spark, "stream-checkpoint"), step=_STEP).awaitTermination()
    return rounded(spark.read.parquet(found))


# --- detectors of a user's own --------------------------------------------------------------

SEASON_SQL = f"""--cte h AS (SELECT model, seq, ts_nanos, v, count(*) OVER w AS n, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS sd FROM ev
      WINDOW w AS (PARTITION BY model, (ts_nanos // 3600000000000) % 24 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    scored AS (SELECT *, (v - mean) / sd AS z FROM h WHERE n >= 20 AND sd > 0.000001)
    SELECT seq AS arrival_seq, ts_nanos, model, 'season-' || model AS detector_id, 'seasonal' AS source, v AS value, round(z, 6) AS score, {SEVERITY_SQL} AS severity
    FROM scored WHERE abs(z) >= 3"""


def _seasonal(spark: SparkSession) -> DataFrame:
    return detectors.detector_rows(spark, [(f"season-model-{k}", f"model-{k}", "seasonal", {"warmup": 20, "threshold": 3.0}) for k in range(8)])


@query("seasonal_anomalies", SEASON_SQL)
def _(spark, d):
    return rounded(detectors.detect(load(spark, d), _seasonal(spark), [detectors.Seasonal()]))


@query("stream_seasonal", SEASON_SQL)
def _(spark, d):
    """The same detector over a served stream of three files, its state kept from batch to batch."""
    rows = load(spark, d)
    files, home = shared_folder(spark, "events-by-arrival"), shared_folder(spark, "serve")
    cuts = rows.agg(F.percentile_approx("arrival_seq", [0.33, 0.67])).first()[0]
    for inside in (F.col("arrival_seq") <= cuts[0], (F.col("arrival_seq") > cuts[0]) & (F.col("arrival_seq") <= cuts[1]), F.col("arrival_seq") > cuts[1]):
        rows.filter(inside).coalesce(1).write.mode("append").parquet(files)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(files)
    own = (_seasonal(spark), [detectors.Seasonal()])
    for running in pipeline.serve(stream, anomaly.detector_table(spark, []), home, shared_folder(spark, "stream-checkpoint"), own=own):
        running.awaitTermination()
    return rounded(pipeline.all_anomalies(spark, home))
