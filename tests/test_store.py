"""The store: windows and objectives from roll-ups, kept tables, and streams that start again."""

from __future__ import annotations

import random
import sys


import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sloscope import queries, stored_queries  # noqa: F401  registers more of them
from sloscope.functions import scalars as S
from sloscope.operators import anomaly, buckets, detectors, pyramid, quantiles, slo, windows
from sloscope.sources import config, events, simulate
from sloscope.streaming import burning, pipeline, store
from sloscope.streaming.kept import Kept

SCHEMA = "arrival_seq long, ts_nanos long, model string, model_version string, latency_ms double, status string, input_tokens long, output_tokens long, cost_usd double, metadata map<string,string>"
DAYS = 40


@pytest.fixture(scope="module")
def traffic(spark):
    """Forty days of sparse events: two models, one of them with labels only, a third that ends early."""
    rng = random.Random(8)
    rows = []
    for k in range(6000):
        model, minute = rng.choice((("a", DAYS * 1440), ("b", DAYS * 1440), ("c", 9000)))
        rows.append((k, rng.randrange(minute) * S.MINUTE_NANOS + 5, model, f"v{k % 3}", rng.expovariate(0.02), rng.choice(("success", "success", "timeout", "client_error")), None, None, None, {"region": "x"} if model == "b" else {}))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def home(spark, traffic, tmp_path_factory):
    """The store of these events in four batches, dealt at random; the second is written twice."""
    folder = str(tmp_path_factory.mktemp("store"))
    for n in (0, 1, 1, 2, 3):
        store.write_store(traffic.filter(F.pmod(F.xxhash64("arrival_seq"), F.lit(4)) == n), n, folder)
    return folder


@pytest.mark.parametrize("minutes,low,high", [(5, 7000, 7000), (60, 7199, 7210), (1440, 8639, 8641), (4320, 9017, 9100), (43200, 55000, 57599)])
def test_blocks_make_up_a_window_once(spark, minutes, low, high):
    for to in {low, high, (low + high) // 2}:
        every = spark.range(0, DAYS * 1440 + 1440)
        found = None
        for level, (size, above) in pyramid.LEVELS.items():
            inside = " OR ".join(f"minute BETWEEN {a} AND {b}" for a, b in pyramid.needed(level, [minutes], low, high))
            rows = every.filter(f"id % {size} = 0").select(F.col("id").alias("minute"), F.lit(size).alias("size"), F.lit(above).cast("int").alias("above")).filter(inside)
            found = rows if found is None else found.union(rows)
        kept = found.filter(pyramid.covers(minutes, F.lit(to)))
        assert kept.count() <= 60 + 60 + 24 + 24 + 31
        held = kept.select(F.explode(F.sequence("minute", F.col("minute") + F.col("size") - 1)).alias("m")).agg(F.count("*"), F.count_distinct("m"), F.min("m"), F.max("m")).first()
        assert tuple(held) == (minutes + 1, minutes + 1, to - minutes, to)


@pytest.mark.parametrize("window,as_of", [("5m", None), ("1h", 57_000), ("1d", 20_000), ("30d", None), ("30d", 57_000)])
def test_window_equals_that_of_the_events(spark, traffic, home, window, as_of):
    want = {repr(r["series"]): r for r in windows.window_query(traffic, window, 0.9, as_of).collect()}
    for r in store.stored_window(spark, home, window, 0.9, as_of).collect():
        w = want.pop(repr(r["series"]))
        for c in ("model", "total", "good", "server_failures", "success_ratio", "model_version_cardinality"):
            assert r[c] == w[c], c
        assert (r["latency_quantile_ms"] is None) == (w["latency_quantile_ms"] is None)
        if w["total"] > 200:
            assert r["latency_quantile_ms"] == pytest.approx(w["latency_quantile_ms"], rel=0.08)
    assert not want


def test_stored_quantiles_are_exact_at_any_number_of_events(spark, tmp_path):
    """More latencies in a minute than its sketch keeps, among them ties and ones that aren't finite; late and early batches."""
    rng = np.random.default_rng(7)
    made = [(m, float(v)) for m, n in ((2879, 9000), (1500, 4000), (1439, 500), (1438, 3000)) for v in rng.gamma(2, 60, n).round(1)]
    rows = [(k, m * S.MINUTE_NANOS, f"m{k % 2}", "v", v, "success", None, None, None, {}) for k, (m, v) in enumerate(made)]
    rows += [(-1, 2879 * S.MINUTE_NANOS, "m0", "v", float("inf"), "success", None, None, None, {}), (-2, 2879 * S.MINUTE_NANOS, "none", "v", float("nan"), "success", None, None, None, {})]
    events_, home = spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}"
    for n in (1, 0, 1):
        store.write_store(events_.filter(F.pmod("arrival_seq", F.lit(2)) == n), n, home)
    for q in (0.0, 0.07, 0.5, 0.95, 1.0):
        got = {r["model"]: (r["total"], r["latency_quantile_ms"]) for r in store.stored_window(spark, home, "1d", q, 2879, exact=True).collect()}
        held = {m: sorted(v for k, (at, v) in enumerate(made) if k % 2 == j and at >= 1439) for j, m in enumerate(("m0", "m1"))}
        least = lambda v: v[max(0, -(-round(q * 100) * len(v) // 100) - 1)]
        assert got == {"m0": (len(held["m0"]) + 1, least(held["m0"])), "m1": (len(held["m1"]), least(held["m1"])), "none": (1, None)}
    plan = store.latencies(spark, home)(1439, 2879)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(minute,1439), LessThanOrEqual(minute,2879)" in plan and "(event_date#" in plan[plan.index("PartitionFilters") :]


@pytest.mark.parametrize("name", ["stored_window_1d", "serve_windows"])
def test_queries_of_days_with_more_latencies_than_a_sketch_keeps(spark, tmp_path, name):
    folder, con = str(tmp_path), duckdb.connect()
    con.sql(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-03-01 10:00:00' + INTERVAL (i * 7 % 2000) MINUTE AS ts, i % 2 AS user_id, 'view' AS event_type,
        round(hash(i) % 100003 / 7, 2)::DOUBLE AS value, '{{"k": ' || i % 100 || '}}' AS props FROM range(30000) t(i)) TO '{folder}/events.parquet'"""
    )
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got, want = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLES[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def objectives(spark):
    slow = ("latency_threshold", 80.0, 0.95)
    return config.slo_table(spark, [config.Slo("a", "a", 0.9, "30d"), config.Slo("as", "a", 0.7, "7d", *slow), config.Slo("b", "b", 0.95, "3d"), config.Slo("bs", "b", 0.95, "3d", *slow), config.Slo("c", "c", 0.8, "30d"), config.Slo("gone", "z", 0.8, "1d")])


@pytest.mark.parametrize("as_of", [None, 30_000])
def test_budgets_equal_those_of_the_events(spark, traffic, home, as_of):
    slos = objectives(spark)
    want, got = (sorted(map(tuple, f.collect())) for f in (slo.budgets(traffic, slos, as_of_minute=as_of), store.stored_budgets(spark, home, slos, as_of_minute=as_of)))
    assert got == want
    longest = S.window_minutes("30d")
    assert sorted(map(tuple, slo.budgets(traffic, slos, as_of_minute=as_of, longest=longest).collect())) == want
    only = slos.filter("sli_kind <> 'latency_threshold'")
    plan = store.stored_budgets(spark, home, only, as_of_minute=as_of)._jdf.queryExecution().executedPlan().toString()
    assert "latency_sketch" not in plan and "latency_ms" not in plan


def test_scans_are_pruned(spark, home):
    plan = store.stored_window(spark, home, "5m", as_of_minute=57_590)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "event_date" in x)
    assert "GreaterThanOrEqual(minute,57585), LessThanOrEqual(minute,57599)" in scan and "(event_date#" in scan[scan.index("PartitionFilters") :]
    assert pyramid.needed("minute", [5], 57_599, 57_599) == [(57_594, 57_599)] and pyramid.needed("hour", [5], 57_599, 57_599) == [(57_594, 57_599)]
    read = store.reader(spark, home)("minute", pyramid.needed("minute", [43200], 57_000, 57_000))
    held = read.select("minute").distinct().count()
    assert 0 < held < 250


def test_empty_store(spark, tmp_path):
    store.write_store(spark.createDataFrame([], SCHEMA), 0, str(tmp_path))
    assert store.stored_window(spark, str(tmp_path), "1d").collect() == []
    rows = store.stored_budgets(spark, str(tmp_path), objectives(spark)).collect()
    assert len(rows) == 6 and all(r["total_full"] == 0 for r in rows)


def test_kept_tables_by_batch(spark, tmp_path):
    table = Kept(spark, f"file://{tmp_path}/t", "k long")
    values = lambda df: sorted(r["k"] for r in df.collect())
    add = lambda stream, n, k: table.put(table.before(stream, n).unionByName(spark.createDataFrame([(k,)], "k long")), stream, n)
    assert values(table.latest()) == []
    for n in (0, 1, 1, 2, 2, 3):
        add("one", n, n)
    assert values(table.latest()) == [0, 1, 2, 3]
    assert sorted(p.name for p in (tmp_path / "t" / "stream_id=one").iterdir() if p.is_dir()) == ["batch_id=2", "batch_id=3"]
    add("two", 0, 10)  # a new stream goes on, and may be run again
    add("two", 0, 10)
    assert values(table.latest()) == [0, 1, 2, 3, 10] and values(table.at("one", 3)) == [0, 1, 2, 3]


def test_a_new_checkpoint_replaces_nothing(spark, tmp_path):
    """The same folder served from two checkpoints, one after the other, with other events."""
    home, known = str(tmp_path / "home"), anomaly.detector_table(spark, [anomaly.zscore_detector("d", "model", warmup=10), anomaly.threshold_detector("t", "model", 400.0)])
    made = simulate.simulate(spark, 50, 60, scenario="tail-latency", seed=5, partitions=2)
    halves = [made.filter("arrival_seq < 1500"), made.filter("arrival_seq >= 1500")]
    for k, half in enumerate(halves):
        half.coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema(half.schema).parquet(str(tmp_path / f"in{k}"))
        for running in pipeline.serve(stream, known, home, str(tmp_path / f"c{k}"), ring=20):
            running.awaitTermination()
    frames = spark.read.format("journal").load(f"{home}/journal")
    assert events.parse_events(frames.withColumnRenamed("seq", "arrival_seq")).count() == 3000
    assert store.stored_window(spark, f"{home}/store", "1h").first()["total"] == 3000
    want = anomaly.detect(made, known)  # the second stream goes on from the states that the first has left
    got = pipeline.all_anomalies(spark, home)
    key = lambda df: sorted((r["arrival_seq"], r["detector_id"], round(r["score"], 6)) for r in df.collect())
    assert key(got) == key(want) and got.count() > 20
    assert key(pipeline.recent_anomalies(spark, home)) == key(anomaly.ring(want, 20))
    assert spark.read.parquet(f"{home}/ring").count() <= 2 * 20


def test_admission_over_batches(spark, tmp_path):
    rows = spark.createDataFrame([(k, k * S.MINUTE_NANOS, m, "v", 1.0, "success", None, None, None, {}) for k, m in enumerate("abacdbeadcfa")], SCHEMA)
    home, admitted = str(tmp_path), []
    for n, (a, b) in enumerate(((0, 3), (3, 3), (3, 8), (3, 8), (8, 12))):  # one batch empty, one run again
        admitted.append([r["arrival_seq"] for r in pipeline.admit(rows.filter(F.col("arrival_seq").between(a, b - 1)), n - (n > 2), home, 3).collect()])
    got = sorted(admitted[0] + admitted[1] + admitted[3] + admitted[4])
    assert sorted(admitted[2]) == sorted(admitted[3])
    assert got == sorted(r["arrival_seq"] for r in buckets.accepted_events(rows, 3).collect())
    assert pipeline.refused_events(spark, home).agg(F.sum("refused")).first()[0] == 12 - len(got)


def test_evaluations_are_kept_over_restarts(spark, traffic, home, tmp_path):
    slos = objectives(spark)
    rows = spark.createDataFrame([(0,)], "x long")
    rows.write.parquet(str(tmp_path / "ticks"))
    keep, seen = str(tmp_path / "keep"), []
    for k, goal in enumerate((10_000, 57_000)):
        found = slo.evaluation_of(store.stored_budgets(spark, home, slos, as_of_minute=goal))
        q = pipeline.evaluate_every(spark.readStream.schema("x long").parquet(str(tmp_path / "ticks")), str(tmp_path / f"c{k}"), lambda n, f=found: seen.append(n) or f, 0, keep)
        q.processAllAvailable()
        q.stop()
        got = pipeline.latest_evaluation(spark, keep).drop("evaluated_at")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, found.collect()))
    assert seen and spark.read.parquet(keep).select("stream_id").distinct().count() == 2


class Doubling(detectors.Detector):
    """A detector of a user's own: a value more than ``times`` the largest before it."""

    kind = "doubling"

    def start(self, settings):
        return None

    def observe(self, values, times, settings, state):
        before = np.maximum.accumulate(np.concatenate(([-np.inf if state is None else state], values)))
        return np.where((before[:-1] > 0) & (values > settings["times"] * before[:-1]), values / before[:-1], np.nan), float(before[-1])


def test_a_detector_of_ones_own_on_tables_and_streams(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    values = [1.0, 3.0, 2.0, 7.0, 8.0, 20.0, 100.0, 30.0, 250.0]
    rows = spark.createDataFrame([(k if k != 2 else None, 10**18 + k, "m", "v", x, "success", None, None, None, {}) for k, x in enumerate(values)], SCHEMA)
    table = detectors.detector_rows(spark, [("twice", "m", "doubling", {"times": 2}), ("four", "m", "doubling", {"times": 4}), ("none", "x", "doubling", {"times": 1})])
    ordered = [2.0, *(v for k, v in enumerate(values) if k != 2)]  # what has no arrival number comes first
    want = sorted((d, v) for d, t in (("twice", 2), ("four", 4)) for k, v in enumerate(ordered) if k and v > t * max(ordered[:k]))
    got = detectors.detect(rows, table, [Doubling()]).collect()
    assert sorted((r["detector_id"], r["value"]) for r in got) == want and {r["ts_nanos"] for r in got} <= {10**18 + k for k in range(9)}
    none = anomaly.detector_table(spark, [])
    for n, part in enumerate((rows.filter("arrival_seq IS NULL OR arrival_seq < 4"), rows.filter("arrival_seq >= 4"))):
        pipeline.detect_batch(part, n, none, str(tmp_path), own=(table, [Doubling()]))
    assert sorted((r["detector_id"], r["value"]) for r in pipeline.all_anomalies(spark, str(tmp_path)).collect()) == want
    with pytest.raises(ValueError, match="doubling"):
        detectors.detect(rows, table, [detectors.Seasonal()])


@pytest.mark.parametrize("q", [0.0, 0.37, 0.95, 1.0])
def test_exact_quantile_by_passes(spark, q):
    rng = np.random.default_rng(3)
    rows = [("wide", float(v)) for v in rng.gamma(2, 50, 4000)] + [("ties", float(v)) for v in rng.integers(0, 4, 3000)] + [("one", 5.0)] * 900 + [("single", 1.5), ("none", None)]
    rows += [("gap", 1.0)] * 500 + [("gap", 9.0)] * 500
    values = spark.createDataFrame(rows, "series string, v double")
    want = {r["series"]: r["x"] for r in values.filter("v IS NOT NULL").groupBy("series").agg(F.percentile("v", F.lit(q)).alias("x")).collect()}
    got = {r["series"]: r["quantile"] for r in quantiles.exact_quantile(values, q, limit=20).collect()}
    assert got == pytest.approx(want)


def test_burn_rates_by_stream_state(spark, tmp_path):
    """Five files in the order of time, with quiet hours: each closed minute as the table has it."""
    rng = random.Random(4)
    minutes = sorted(rng.choice((rng.randrange(0, 400), rng.randrange(900, 1500))) for _ in range(900))
    rows = [(k, m * S.MINUTE_NANOS + k, rng.choice("ab"), "v", rng.expovariate(0.01), rng.choice(("success", "success", "timeout")), None, None, None, {}) for k, m in enumerate(minutes)]
    events_ = spark.createDataFrame([*rows, (999, 1600 * S.MINUTE_NANOS, "b", "v", 1.0, "success", None, None, None, {})], SCHEMA)
    files = str(tmp_path / "in")
    for n in range(5):
        events_.filter(F.col("arrival_seq").between(n * 200, n * 200 + 199)).coalesce(1).write.mode("append").parquet(files)
    slos = config.slo_table(spark, [config.Slo("a", "a", 0.9, "30d"), config.Slo("as", "a", 0.8, "30d", "latency_threshold", 90.0, 0.95), config.Slo("b", "b", 0.95, "30d")])
    tiers = ((1, 2.0, 60, 5, "page", "fast"), (2, 1.0, 700, 30, "ticket", "slow"))
    stream = spark.readStream.schema(events_.schema).option("maxFilesPerTrigger", 1).parquet(files)
    burning.write_burning(stream, slos, str(tmp_path / "out"), str(tmp_path / "c"), tiers, step=7).awaitTermination()
    key = lambda df: sorted((r["slo"], r["minute"], r["tier_no"], round(r["long_burn_rate"], 9), round(r["short_burn_rate"], 9), r["fires"]) for r in df.collect())
    got = spark.read.parquet(str(tmp_path / "out"))
    want = slo.timeline(events_.filter("arrival_seq < 999"), slos, tiers, 7)
    last = {r["slo"]: r["m"] for r in want.groupBy("slo").agg(F.max("minute").alias("m")).collect()}
    closed = [r for r in key(got) if r[1] <= last[r[0]] and r[1] < 1599]
    assert closed == [r for r in key(want) if r[1] < 1599] and any(r[5] for r in closed)
    assert max(r[1] for r in key(got)) == 1599 // 7 * 7  # quiet minutes close by timer


def test_compaction_replaces_days_at_once(spark, traffic, tmp_path, monkeypatch):
    home, some = str(tmp_path), traffic.filter("ts_nanos < 60000000000 * 4000")
    for n in range(3):
        store.write_store(some.filter(F.col("arrival_seq") % 3 == n), n, home)
    every = [(0, 5000)]
    read = lambda: store.reader(spark, home)("minute", every)
    sums = lambda: sorted((repr(r["series"]), r["minute"], r["success"], r["timeout"]) for r in buckets.merge_buckets(read()).collect())
    want, rows = sums(), read().count()
    with monkeypatch.context() as broken:  # a compaction that ends before its table is kept
        broken.setattr(Kept, "put", lambda *_: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            store.compact(spark, home)
    assert sums() == want and read().count() == rows
    assert store.compact(spark, home, before_minute=2880) == 2  # the third day is still open
    assert sums() == want and 0 < read().count() < rows
    assert store.compact(spark, home, before_minute=2880) == 0
    store.write_store(traffic.filter("arrival_seq < 40").withColumn("ts_nanos", F.lit(5).cast("long")), 3, home)  # late events
    late = sums()
    assert store.compact(spark, home) == 2 and sums() == late
    assert read().select("event_date", "stream_id", "batch_id").distinct().groupBy("event_date").count().filter("count > 1").isEmpty()
    assert not list(tmp_path.glob("minute/stream_id=none/batch_id=0/event_date=1970-01-01/*.parquet"))  # deleted a compaction later
