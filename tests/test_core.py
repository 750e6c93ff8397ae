"""Scenario fixtures of the engine: each number was worked out by hand or by a scalar loop."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sloscope.functions import scalars as S
from sloscope.operators import anomaly, buckets, incident, sketches, slo, windows
from sloscope.plans import dashboard
from sloscope.sources import config, events, simulate

SCHEMA = "arrival_seq long, ts_nanos long, model string, model_version string, latency_ms double, status string, input_tokens long, output_tokens long, cost_usd double, metadata map<string,string>"


def event(seq, minute, status="success", latency=10.0, model="m", version="v1", **labels):
    return seq, minute * S.MINUTE_NANOS, model, version, float(latency), status, None, None, None, labels


@pytest.fixture(scope="module")
def made(spark):
    return lambda rows: spark.createDataFrame(list(rows), SCHEMA)


def minutes(spark, spec):
    """Events from (minutes, events a minute, every n-th bad or a predicate on the event's number)."""
    parts = []
    for first, last, each, bad in spec:
        rows = spark.range((last - first + 1) * each).select((F.floor(F.col("id") / each) + first).cast("long").alias("minute"), (F.col("id") % each).alias("i"))
        status = F.when(F.expr(bad), "server_error").otherwise("success")
        parts.append(rows.select(F.col("minute"), status.alias("status"), F.when(F.expr(bad), 1750.0).otherwise(40.0).alias("latency_ms")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.select(
        F.monotonically_increasing_id().alias("arrival_seq"), (F.col("minute") * S.MINUTE_NANOS).alias("ts_nanos"), F.lit("m").alias("model"), F.lit("v1").alias("model_version"), "latency_ms", "status",
        F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), F.lit(None).cast("double").alias("cost_usd"), events.empty_metadata().alias("metadata"),
    )


def one(df):
    (row,) = df.collect()
    return row


# --- windows and buckets ----------------------------------------------------------------


def test_basic_window(made):
    rows = made(event(i, 1, "server_error" if i % 10 == 0 else "success", 100 + i) for i in range(100))
    r = one(windows.model_query(rows, "m", "5m", 0.95, 2))
    assert (r["total"], r["good"], r["server_failures"], r["success_ratio"]) == (100, 90, 10, 0.9)
    assert r["latency_quantile_ms"] == pytest.approx(100 + 0.95 * 99)


def test_unknown_model_and_empty_store(made):
    assert windows.model_query(made([]), "m", "1h").collect() == []
    assert windows.model_query(made([event(0, 0)]), "other", "1h").collect() == []


def test_window_covers_one_bucket_more_and_the_edge_follows_the_series(made):
    rows = made(event(i, i) for i in range(70))
    assert one(windows.model_query(rows, "m", "5m", as_of_minute=69))["total"] == 6
    assert one(windows.model_query(rows, "m", "30s", as_of_minute=69))["total"] == 1
    assert one(windows.model_query(rows, "m", "5m", as_of_minute=10))["total"] == 6  # the last event is later
    late = one(windows.model_query(rows, "m", "5m", as_of_minute=500))
    assert (late["total"], late["success_ratio"], late["latency_quantile_ms"], late["model_version_cardinality"]) == (0, None, None, 1)


def test_window_filters_reach_the_scan(made, tmp_path, spark):
    path = str(tmp_path / "events")
    made(event(i, i) for i in range(70)).write.parquet(path)
    plan = windows.latency_above(spark.read.parquet(path), "5m", 1.0, as_of_minute=69)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(ts_nanos,{64 * S.MINUTE_NANOS})" in plan
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "latency_ms" in schema and "status" not in schema and "cost_usd" not in schema


def test_series_cap(made):
    rows = made([event(0, 0, model="a"), event(1, 0, model="b"), event(2, 0, model="c"), event(3, 0, model="a")])
    got = {(r["model"], r["accepted"]) for r in buckets.with_admission(rows, 2).collect()}
    assert got == {("a", True), ("b", True), ("c", False)}
    assert buckets.accepted_events(rows, 2).count() == 3


def test_out_of_order_and_retention(made):
    rows = made(event(i, m) for i, m in enumerate((5, 3, 5, 1, 4)))
    assert [(r["minute"], r["success"]) for r in buckets.minute_buckets(rows).orderBy("minute").collect()] == [(1, 1), (3, 1), (4, 1), (5, 2)]
    rows = made(event(i, 10 * i) for i in range(10))
    assert sorted(r["minute"] for r in buckets.retain_newest(buckets.minute_buckets(rows), 3).collect()) == [70, 80, 90]


def test_latency_above(made):
    rows = made([event(i, 0, latency=10) for i in range(500)] + [event(500 + i, 0, latency=1000) for i in range(500)])
    assert [one(windows.latency_above(rows, "5m", x))["count_above"] for x in (500, 5000, 1)] == [500, 0, 1000]


def test_non_finite_latency_counts_but_is_not_measured(made):
    rows = made([event(0, 0, latency=math.nan), event(1, 0, latency=math.inf), event(2, 0, latency=7)])
    r = one(windows.model_query(rows, "m", "1m"))
    assert (r["total"], r["latency_quantile_ms"]) == (3, 7.0)
    assert one(windows.latency_above(rows, "1m", 1.0))["count_above"] == 1
    b = buckets.minute_buckets(rows, sketches=True)
    assert one(b.select(F.kll_sketch_get_n_double("latency_sketch").alias("n")))["n"] == 1


def test_series_identity(made):
    rows = made([event(0, 0, region="a", zone="b"), event(1, 0, zone="b", region="a"), event(2, 0, model="x"), event(3, 0, model="y")])
    assert buckets.with_series(rows).select("series").distinct().count() == 3  # the order of labels does not matter
    over = made([(9, 0, "mine", "v", 1.0, "success", None, None, None, {"model": "other"})])
    assert one(buckets.with_series(over).select(S.series_text().alias("t")))["t"] == "inference{model=other}"


def test_label_fallback_is_the_first_key_and_prefers_the_bare_series(made):
    labelled = [event(0, 0, region="b"), event(1, 0, region="a"), event(2, 0, region="a")]
    assert one(windows.model_query(made(labelled), "m", "1h"))["total"] == 2
    assert one(windows.model_query(made([*labelled, event(3, 0)]), "m", "1h"))["total"] == 1


def test_versions_are_counted_over_the_series_life(made):
    rows = made([event(i, i, version=f"v{i % 2}") for i in range(10)] + [event(99, 500, version="v0")])
    assert one(windows.model_query(rows, "m", "5m"))["model_version_cardinality"] == 2
    seen = one(sketches.windowed_versions(buckets.minute_buckets(rows, sketches=True), "5m"))
    assert seen["versions_in_window"] == 1


def test_partial_buckets_merge_to_the_same(made):
    rows = made(event(i, i % 7, random.Random(i).choice(S.STATUSES), i) for i in range(200))
    whole = buckets.minute_buckets(rows)
    parts = buckets.minute_buckets(rows.filter("arrival_seq < 90")).union(buckets.minute_buckets(rows.filter("arrival_seq >= 90")))
    merged = buckets.merge_buckets(parts).select(whole.columns)
    assert merged.exceptAll(whole).count() == whole.exceptAll(merged).count() == 0


# --- objectives ---------------------------------------------------------------------------


def objective(spark, **changes):
    return config.slo_table(spark, [config.Slo(**({"name": "s", "model": "m", "objective": 0.99, "window": "30d"} | changes))])


def tiers_of(row):
    return [a["tier_label"] for a in row["alerts"]]


def test_a_third_of_bad_calls_fires_every_tier(spark):
    rows = minutes(spark, [(0, 94, 240, "i % 3 = 1")])
    r = one(slo.evaluate(rows, objective(spark), as_of_minute=94))
    assert tiers_of(r) == ["fast", "moderate", "slow"]
    fast = r["alerts"][0]
    assert (fast["short_total"], fast["long_total"]) == (6 * 240, 61 * 240) and fast["long_burn_rate"] == pytest.approx(100 / 3)


def test_no_bad_calls_and_a_slow_burn(spark):
    assert tiers_of(one(slo.evaluate(minutes(spark, [(0, 44, 90, "false")]), objective(spark)))) == []
    r = one(slo.evaluate(minutes(spark, [(0, 44, 640, "i % 64 = 9")]), objective(spark)))
    assert tiers_of(r) == ["slow"] and r["burn_rate_1h"] == pytest.approx(1.5625)
    r = one(slo.evaluate(minutes(spark, [(0, 44, 500, "i % 25 = 9")]), objective(spark)))
    assert r["burn_rate_full_window"] == pytest.approx(4.0) and r["budget_remaining"] == pytest.approx(-3.0) and tiers_of(r) == ["slow"]


def test_short_windows_clear_when_calls_are_good_again(spark):
    rows = minutes(spark, [(0, 19, 300, "i % 3 = 0"), (20, 51, 300, "false")])
    r = one(slo.evaluate(rows, objective(spark), as_of_minute=51))
    assert tiers_of(r) == ["slow"] and r["burn_rate_1h"] == pytest.approx(100 * 2000 / 15600)
    line = slo.timeline(rows, objective(spark), step=17).filter("tier_label = 'fast'").orderBy("minute").collect()
    assert [(x["minute"], x["fires"]) for x in line] == [(0, True), (17, True), (34, False), (51, False)]


def test_two_bad_stretches(spark):
    rare, bad = "i % 300 = 0", "i % 4 <> 1"
    rows = minutes(spark, [(0, 14, 600, rare), (15, 27, 600, bad), (28, 44, 600, rare), (45, 52, 600, bad), (53, 75, 600, rare)])
    r = one(slo.evaluate(rows, objective(spark), as_of_minute=75))
    assert tiers_of(r) == ["moderate", "slow"]
    assert r["alerts"][0]["long_burn_rate"] == pytest.approx(100 * (21 * 450 + 55 * 2) / 45600)


def test_latency_objective(spark):
    slow = {"sli_kind": "latency_threshold", "threshold_ms": 260.0, "quantile": 0.95}
    rows = minutes(spark, [(0, 33, 120, "i % 6 = 5")])
    r = one(slo.evaluate(rows, objective(spark, **slow)))
    assert r["burn_rate_1h"] == pytest.approx(100 / 6) and "fast" in tiers_of(r)
    quiet = one(slo.evaluate(rows, objective(spark, **(slow | {"threshold_ms": 4000.0}))))
    assert quiet["burn_rate_1h"] == 0 and tiers_of(quiet) == []


def test_latency_objective_does_not_fall_back_to_labelled_series(made, spark):
    rows = made([event(i, 0, "server_error", 999, region="a") for i in range(10)])
    slow = objective(spark, sli_kind="latency_threshold", threshold_ms=1.0, quantile=0.95)
    assert one(slo.evaluate(rows, slow))["burn_rate_1h"] == 0
    assert one(slo.evaluate(rows, objective(spark)))["burn_rate_1h"] == pytest.approx(100)


def test_missing_series_and_empty_store(made, spark):
    for rows in (made([]), made([event(0, 0, "timeout", model="other")])):
        r = one(slo.evaluate(rows, objective(spark)))
        assert (r["burn_rate_1h"], r["burn_rate_full_window"], r["budget_remaining"], r["alerts"]) == (0, 0, 1, [])


def test_client_errors_are_bad_and_custom_tiers_count(made, spark):
    rows = made([event(i, 0, "client_error" if i < 5 else "success") for i in range(10)])
    tiers = ((1, 49.0, 10, 5, "page", "custom"), (2, 51.0, 10, 5, "page", "never"))
    r = one(slo.evaluate(rows, objective(spark), tiers))
    assert tiers_of(r) == ["custom"] and one(slo.fired_count(slo.evaluate(rows, objective(spark), tiers)))["fired"] == 1


@pytest.mark.parametrize("total,bad,goal,burn,left", [(10000, 100, 0.99, 1, 0), (10000, 200, 0.99, 2, -1), (0, 0, 0.999, 0, 1), (1000, 1, 1.0, math.inf, 1), (1000, 0, 1.0, 0, 1)])
def test_budgets(spark, total, bad, goal, burn, left):
    t, b, o = F.lit(total), F.lit(bad), F.lit(goal)
    r = one(spark.range(1).select(S.burn_rate(t, b, o).alias("burn"), S.budget_remaining(t, b, o).alias("left")))
    assert r["burn"] == pytest.approx(burn) and r["left"] == pytest.approx(left)


# --- detectors ----------------------------------------------------------------------------


def waves():
    """A slow wave with ripples, one dip and one jump."""
    values = [320 + 40 * math.sin(k / 23) + 6 * (k * 0.6180339887 % 1) for k in range(420)]
    values[263], values[377] = 12.0, 2100.0
    return values


def zscores(spark, made, values, **settings_):
    rows = made(event(i, i, latency=v) for i, v in enumerate(values))
    return anomaly.detect(rows, anomaly.detector_table(spark, [anomaly.zscore_detector("d", "m", **settings_)])).orderBy("arrival_seq").collect()


def fired(values, alpha, threshold, warmup):
    """Places and scores of the anomalies, value by value."""
    z = stepwise(values, alpha)[0]
    return [(k, score) for k, score in enumerate(z) if k + 1 >= warmup and abs(score) >= threshold]


@pytest.mark.parametrize("alpha,threshold,warmup", [(0.07, 5.0, 45), (0.3, 4.0, 2), (0.02, 3.5, 300)])
def test_dip_and_jump(spark, made, alpha, threshold, warmup):
    got = zscores(spark, made, waves(), alpha=alpha, threshold=threshold, warmup=warmup)
    want = fired(waves(), alpha, threshold, warmup)
    assert [r["arrival_seq"] for r in got] == [k for k, _ in want]
    assert [r["score"] for r in got] == pytest.approx([z for _, z in want])
    assert 377 in [k for k, _ in want]
    if alpha == 0.07:
        assert [(r["arrival_seq"], r["severity"]) for r in got] == [(263, "critical"), (377, "critical")]


def test_steady_growth_is_none(spark, made):
    assert zscores(spark, made, [30 * 1.004**k for k in range(300)], alpha=0.15, threshold=4.5, warmup=60) == []


def test_jump_after_a_nearly_flat_series(spark, made):
    values = [*(60.0 + k % 4 for k in range(88)), 9000.0]
    (r,) = zscores(spark, made, values, alpha=0.2, threshold=8.0, warmup=40)
    assert r["arrival_seq"] == 88 and r["score"] == pytest.approx(fired(values, 0.2, 8.0, 40)[-1][1])


def test_warmup_and_flat_series(spark, made):
    assert zscores(spark, made, [1.0, 2.0, 900.0]) == []
    assert zscores(spark, made, [5.0] * 100 + [6.0]) == []  # no spread, no score


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=200), st.floats(0.01, 1.0), st.integers(0, 200))
def test_ewma_state_carries_over_and_stays_in_range(values, alpha, cut):
    x = np.array(values)
    z, mean, variance = anomaly.ewma(x, alpha)
    assert (variance >= 0).all() and x.min() - 1e-3 <= mean.min() and mean.max() <= x.max() + 1e-3
    cut = min(cut, len(x))
    if 0 < cut < len(x):
        _, m, v = anomaly.ewma(x[:cut], alpha)
        z2, m2, v2 = anomaly.ewma(x[cut:], alpha, cut, m[-1], v[-1])
        np.testing.assert_array_equal(np.concatenate((m, m2)), mean)
        np.testing.assert_array_equal(z2, z[cut:])
        np.testing.assert_array_equal(v2, variance[cut:])


def stepwise(values, alpha):
    """The recurrence as it is written down, value by value."""
    n, mean, variance, rows = 0, 0.0, 0.0, []
    for x in values:
        z = (x - mean) / variance**0.5 if n >= 2 and variance**0.5 > np.finfo(float).eps else math.nan
        mean, variance = (x, 0.0) if n == 0 else (mean + alpha * (x - mean), (1 - alpha) * (variance + alpha * (x - mean) ** 2))
        n += 1
        rows.append((z, mean, variance))
    return np.array(rows).T


@pytest.mark.parametrize("alpha", [0.001, 0.05, 0.7, 1.0])
def test_chunks_give_the_recurrence(spark, made, alpha):
    rng = np.random.default_rng(3)
    spiky = rng.gamma(2.0, 40.0, 700) + np.where(rng.random(700) < 0.01, 3000, 0)
    rows = made(event(i, i, latency=float(v)) for i, v in enumerate(spiky))
    known = anomaly.detector_table(spark, [anomaly.zscore_detector("a", "m", alpha=alpha), anomaly.zscore_detector("b", "m", alpha=alpha)])
    got, same = (anomaly.zscore_states(rows, known, chunk_bits=4).filter(F.col("detector_id") == d).orderBy("arrival_seq").toPandas() for d in "ab")
    assert got.drop(columns="detector_id").equals(same.drop(columns="detector_id"))
    z, means, variances = stepwise(spiky.tolist(), alpha)
    assert got["n"].tolist() == list(range(1, 701))
    np.testing.assert_allclose(got["mean"], means, rtol=1e-9)
    np.testing.assert_allclose(got["variance"], variances, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got["z"].astype(float), z, rtol=1e-8, atol=1e-9)
    flat = made(event(i, i, latency=9.1 if i == 90 else 0.1) for i in range(91))
    flat = anomaly.zscore_states(flat, known, chunk_bits=3).toPandas()
    assert flat["z"].isna().all() and (flat.loc[flat["arrival_seq"] < 90, "variance"] == 0).all()


def test_registry_thresholds_and_ring(spark, made):
    rows = made([event(0, 0, latency=50), event(1, 0, latency=5), event(2, 0, model="unknown", latency=9999), event(3, 0, latency=math.nan)])
    limits = [anomaly.threshold_detector(f"d{k}", "m", x) for k, x in enumerate((10.0, 20.0, 1000.0))] + [anomaly.threshold_detector("low", "m", 6.0, "below", "info")]
    got = anomaly.detect(rows, anomaly.detector_table(spark, limits))
    assert sorted((r["detector_id"], r["arrival_seq"], r["score"]) for r in got.collect()) == [("d0", 0, 40.0), ("d1", 0, 30.0), ("low", 1, 1.0)]
    assert [r["arrival_seq"] for r in anomaly.ring(got, 2).collect()] == [0, 1]
    assert anomaly.once_each(got.union(got)).count() == 3
    with pytest.raises(ValueError):
        anomaly.zscore_detector("d", "m", alpha=0.0)
    with pytest.raises(ValueError):
        anomaly.threshold_detector("d", "m", 1.0, "sideways")


def test_two_objectives_report_twice(spark, made):
    rows = made(event(i, i, latency=10000 if i == 99 else 50 + i % 3) for i in range(100))
    slos = config.slo_table(spark, [config.Slo("a", "m", 0.9, "1d"), config.Slo("b", "m", 0.9, "1d")])
    got = anomaly.detect(rows, anomaly.detectors_for(slos))
    assert got.count() == 2 and anomaly.once_each(got).count() == 1


# --- sketches -----------------------------------------------------------------------------


@pytest.mark.parametrize("q", [0.5, 0.95, 0.99])
def test_sketch_ranks(spark, q):
    rows = simulate.simulate(spark, 1000, 60, seed=5, partitions=4)
    r = one(sketches.sketch_window(buckets.minute_buckets(rows, sketches=True), "1h", q))
    exact = rows.agg(F.avg((F.col("latency_ms") <= r["latency_quantile_ms"]).cast("double"))).first()[0]
    assert r["n"] == 60_000 and abs(exact - q) < 0.005


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=200))
def test_sketch_properties(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    sketch = rows.agg(F.kll_sketch_agg_double("v", F.lit(800)).alias("s"))
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    r = one(sketch.select(*[sketches.quantile_of("s", q).alias(f"q{k}") for k, q in enumerate(qs)], *[sketches.rank_of("s", x).alias(f"c{k}") for k, x in enumerate((-2e9, 0.0, 2e9))], sketches.count_above("s", 0.0).alias("above")))
    found = [r[f"q{k}"] for k in range(len(qs))]
    assert found == sorted(found) and min(values) <= found[0] and found[-1] <= max(values)
    assert r["c0"] == 0 <= r["c1"] <= r["c2"] == 1 and r["above"] <= len(values)


def test_window_query_with_a_sketch(spark):
    rows = simulate.simulate(spark, 1000, 30, seed=6, partitions=4)
    exact, close = (one(windows.window_query(rows, "1h", 0.95, exact=x)) for x in (True, False))
    assert exact["total"] == close["total"] == 30_000
    assert close["latency_quantile_ms"] == pytest.approx(exact["latency_quantile_ms"], rel=0.02)


def test_distinct_sketch_is_idempotent_and_unions(spark):
    rows = spark.range(3000).selectExpr("cast(id % 500 AS string) AS a", "cast(250 + id % 500 AS string) AS b")
    r = one(rows.agg(F.hll_sketch_agg("a", 10).alias("x"), F.hll_sketch_agg("b", 10).alias("y")).selectExpr("hll_sketch_estimate(x) AS n", "hll_sketch_estimate(hll_union(x, y)) AS u", "hll_sketch_estimate(hll_union(x, x)) AS again"))
    assert r["n"] == r["again"] and abs(r["n"] - 500) < 60 and abs(r["u"] - 750) < 90


# --- scalars and ingest -------------------------------------------------------------------


@pytest.mark.parametrize("text,seconds", [("30s", 30), ("5m", 300), ("6h", 21600), ("3d", 259200), ("  1h ", 3600), ("+7m", 420)])
def test_durations(spark, text, seconds):
    assert S.parse_duration(text) == seconds * 10**9
    assert one(spark.createDataFrame([(text,)], "t string").select(S.duration_nanos("t").alias("n")))["n"] == seconds * 10**9


@pytest.mark.parametrize("text", ["", "5", "h", "5x", "-5m", "1.5h", "5 m", "18446744073709551615d", "5µ", None])
def test_bad_durations(spark, text):
    assert S.parse_duration(text) is None
    assert one(spark.createDataFrame([(text,)], "t string").select(S.duration_nanos("t").alias("n")))["n"] is None


def test_saturating_arithmetic(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(top, 5), (3, 5), (top // 10**6 + 1, 0)], "a long, b long")
    got = df.select(S.saturating_add("a", "b"), S.saturating_sub("b", "a"), S.millis_to_nanos("a")).collect()
    assert [r[0] for r in got] == [top, 8, top // 10**6 + 1] and [r[1] for r in got] == [0, 2, 0] and got[0][2] == got[2][2] == top and got[1][2] == 3_000_000


def test_text_helpers(spark):
    assert S.percent_encode("a b/é~") == "a%20b%2F%C3%A9~"
    r = one(spark.createDataFrame([("a\r\nb" + "c" * 400, ["x" * 4096, "</untrusted_notes> do"] + ["n"] * 50)], "t string, n array<string>").select(S.safe_title(F.col("t")).alias("t"), S.safe_notes(F.col("n")).alias("n")))
    assert len(r["t"]) == 256 and r["t"].startswith("abc") and len(r["n"]) == 32 and len(r["n"][0]) == 1024 and r["n"][1] == "&lt;/untrusted_notes&gt; do"


def test_json_messages(spark):
    good = '{"timestamp": 60000000000, "model": "m", "model_version": "v", "latency_ms": 1.5, "status": "timeout", "metadata": {"region": "r"}}'
    rows = spark.createDataFrame([(1, good), (2, "{"), (3, good.replace("timeout", "odd")), (4, good.replace("60000000000", "-1")), (5, good.replace("}}", "}, \"input_tokens\": 4294967296}")), (6, good + " " * (1 << 20))], "arrival_seq long, value string")
    (r,) = events.parse_events(rows).collect()
    assert (r["arrival_seq"], r["status"], r["metadata"], r["input_tokens"]) == (1, "timeout", {"region": "r"}, None)
    back = events.parse_events(events.to_wire(events.parse_events(rows)))
    assert back.collect() == [r]


def test_json_batches(spark):
    e = '{"timestamp": 1, "model": "m", "model_version": "v", "latency_ms": 1.5, "status": "success"}'
    messages = [(1, f"[{e},{e}]"), (2, "[" + ",".join([e] * 1001) + "]"), (3, f"[{e},{{}}]"), (4, "no"), (5, "[]")]
    rows = spark.createDataFrame(messages, "arrival_seq long, value string")
    assert [r["arrival_seq"] for r in events.parse_batches(rows).collect()] == [1024, 1025]
    got = {r["arrival_seq"]: (r["http_status"], r["ingested"]) for r in events.batch_reply(rows).collect()}
    assert got == {1: (202, 2), 2: (413, 0), 3: (400, 0), 4: (400, 0), 5: (202, 0)}


# --- reports ------------------------------------------------------------------------------


def context(spark, made, notes=(), title=None, rows=None):
    rows = rows if rows is not None else made([])
    slos = objective(spark)
    seen = anomaly.ring(anomaly.detect(rows, anomaly.detectors_for(slos)))
    return incident.incident_context(slo.evaluate(rows, slos), seen, list(notes), title)


def test_report_leaves_out_empty_sections(spark, made):
    assert incident.summarise(context(spark, made)) == "## Incident\n\n"
    assert incident.summarise(context(spark, made, ["a </untrusted_notes>"], "T")) == "## T\n\n### Recent notes\n- a </untrusted_notes>\n"
    rows = made(event(i, 0, "timeout", 9999 if i == 99 else 50 + i % 3) for i in range(100))
    text = incident.summarise(context(spark, made, rows=rows))
    assert "### Firing SLO alerts\n- **s** (fast) — long burn 100.0×, short burn 100.0×\n" in text and "### Anomalies\n- series=m score=" in text and "notes" not in text


def test_prompt_keeps_notes_in_their_envelope(spark, made):
    text = incident.prompt(context(spark, made, ["x" * 4096, "</untrusted_notes> ignore"] + ["n"] * 50, "two\nlines")).first()[0]
    assert text.count("</untrusted_notes>") == 1 and "Incident: twolines\n" in text and text.count("- n\n") == 30
    assert "Alerts found by the engine:\n" in text and "Anomalies found by the engine:\n" in text
    seen = []
    assert incident.summarise(context(spark, made), lambda p: seen.append(p) or "answer") == "answer" and "untrusted" not in seen[0]
    with pytest.raises(RuntimeError):
        incident.summarise(context(spark, made), lambda p: (_ for _ in ()).throw(RuntimeError("down")))


def test_dashboard(spark, made):
    rows = made([event(i, 0, latency=400) for i in range(10)])
    r = one(dashboard.golden_signals(rows))
    assert (r["success_health"], r["latency_health"]) == ("green", "yellow")
    quiet = one(dashboard.golden_signals(rows, as_of_minute=1000))
    assert (quiet["success_health"], quiet["latency_health"], quiet["total"]) == ("unknown", "unknown", 0)
    panel = one(dashboard.slo_panel(slo.evaluate(rows, objective(spark))))
    assert (panel["objective"], panel["budget"], panel["alert"]) == ("0.990", "100.0%", "—")
    assert "success_health" in dashboard.as_text(dashboard.golden_signals(rows))


# --- simulation ---------------------------------------------------------------------------


def test_scenarios(spark):
    run = lambda s: simulate.simulate(spark, 200, 100, scenario=s, seed=3, partitions=4).withColumn("frac", F.expr("ts_nanos / 100e9"))
    bad = F.avg((~S.is_good()).cast("double"))
    assert one(run("baseline").agg(bad.alias("x")))["x"] < 0.01
    assert one(run("burst").filter("frac BETWEEN 0.2 AND 0.399").agg(bad.alias("x")))["x"] > 0.2
    assert one(run("burst").filter("frac > 0.45").agg(bad.alias("x")))["x"] < 0.01
    drift = run("drift")
    ratio = drift.filter("frac > 0.9").agg(F.avg("latency_ms")).first()[0] / drift.filter("frac < 0.1").agg(F.avg("latency_ms")).first()[0]
    assert 2 < ratio < 4
    assert 0.001 < one(run("tail-latency").agg(F.avg((F.col("latency_ms") > 400).cast("double")).alias("x")))["x"] < 0.05
    assert {tuple(r) for r in run("rollout").groupBy("model_version").count().collect()} == {("v1", 10000), ("v1-new", 10000)}
    assert sorted(run("drift").limit(50).collect()) == sorted(drift.limit(50).collect())
    with pytest.raises(ValueError):
        simulate.simulate(spark, scenario="none")
