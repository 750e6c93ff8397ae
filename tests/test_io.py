"""Journal, configuration, streams and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sloscope import cli
from sloscope.operators import anomaly, buckets, windows
from sloscope.sources import config, events, journal, simulate
from sloscope.streaming import pipeline


@pytest.fixture()
def written(tmp_path):
    path = str(tmp_path / "a.journal")
    with journal.JournalFile(path) as j:
        for k in range(50):
            j.append({"timestamp": k, "model": "m", "model_version": "v", "latency_ms": 1.0, "status": "success"})
        size = j.bytes_written
    assert size == (tmp_path / "a.journal").stat().st_size
    return tmp_path / "a.journal"


def test_journal_round_trip(spark, written, tmp_path):
    journal.register(spark)
    rows = spark.read.format("journal").load(str(written))
    assert rows.count() == 50
    parsed = events.parse_events(rows.withColumn("arrival_seq", F.col("frame")))
    assert sorted(r["ts_nanos"] for r in parsed.collect()) == list(range(50))
    out = str(tmp_path / "out")
    rows.select("value").repartition(3).write.format("journal").mode("append").save(out)
    back = spark.read.format("journal").load(out)
    assert back.count() == 50 and back.select("path").distinct().count() == 3
    rows.limit(5).select("value").write.format("journal").mode("overwrite").save(out)
    assert spark.read.format("journal").load(out).count() == 5
    assert journal.journal_size(spark, out).agg(F.sum("length")).first()[0] > 0


def test_bit_flip_oversize_and_bad_magic(spark, written):
    journal.register(spark)
    whole = written.read_bytes()
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 1
    for broken, kept in ((bytes(flipped), range(1, 50)), (whole[:8] + b"\xff\xff\xff\xff" + whole[12:], [0]), (b"NOPE" + whole[4:], [0])):
        written.write_bytes(broken)
        with pytest.raises(Exception, match="at byte"):
            spark.read.format("journal").load(str(written)).count()
        assert spark.read.format("journal").option("on_corrupt", "stop").load(str(written)).count() in kept


def test_torn_tail_ends_cleanly_and_is_cut_off_on_open(written):
    whole = written.read_bytes()
    written.write_bytes(whole[:-4])
    assert len(list(journal.read_frames(str(written)))) == 49
    with journal.JournalFile(str(written)) as j:
        j.append("{}")
    assert [p for _, p in journal.read_frames(str(written))][-1] == b"{}" and len(list(journal.read_frames(str(written)))) == 50
    with pytest.raises(ValueError):
        journal.frame(b"x" * ((1 << 20) + 1))


def yaml_file(tmp_path, text):
    path = tmp_path / "c.yaml"
    path.write_text(text)
    return str(path)


GOOD = """
retention_minutes: 10
slos:
  - {name: a, model: m, sli: {kind: success_ratio}, objective: 0.99, window: 30d}
  - {name: b, model: m, sli: {kind: latency_threshold, threshold_ms: 5}, objective: 0.9, window: 7d}
"""


def test_configuration(tmp_path):
    assert config.load_config() == config.Config()
    c = config.load_config(yaml_file(tmp_path, GOOD))
    assert (c.retention_minutes, c.eval_interval_secs, c.listen) == (10, 10, "127.0.0.1:9090")
    assert [(s.sli_kind, s.threshold_ms, s.quantile, s.window_nanos) for s in c.slos] == [("success_ratio", None, None, 30 * 86400 * 10**9), ("latency_threshold", 5.0, 0.95, 7 * 86400 * 10**9)]
    assert config.load_config(yaml_file(tmp_path, "")) == config.Config()
    for bad in ("slos: [{name: a}]", "[1]", "a: [", GOOD.replace("30d", "30x"), GOOD.replace("success_ratio", "odd"), "retention_minutes: many"):
        with pytest.raises(config.ConfigError):
            config.load_config(yaml_file(tmp_path, bad))
    assert config.load_config(yaml_file(tmp_path, GOOD.replace("30d", "30x")), lenient=True).slos[0].window_nanos == 0
    with pytest.raises(config.ConfigError):
        config.load_config(str(tmp_path / "none.yaml"))


@pytest.fixture()
def traffic(spark, tmp_path):
    made = simulate.simulate(spark, 300, 120, scenario="tail-latency", seed=11, partitions=3)
    path = str(tmp_path / "traffic")
    for part in range(4):  # one after the other, so that a stream takes them in order
        made.filter(F.expr(f"arrival_seq div 9000 = {part}")).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def test_stream_equals_batch(spark, traffic, tmp_path):
    path, rows = traffic
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    folder, seen = str(tmp_path / "buckets"), []
    pipeline.ingest(stream, folder, str(tmp_path / "c1"), also=lambda b, n: seen.append(n)).awaitTermination()
    assert len(seen) == 4
    whole = buckets.minute_buckets(rows).select("series", "minute", *buckets.COUNTERS)
    merged = pipeline.read_buckets(spark, folder).select(whole.columns)
    assert merged.exceptAll(whole).count() == whole.exceptAll(merged).count() == 0
    pipeline.write_buckets(rows.limit(0), 0, folder + "-x")
    pipeline.compact_buckets(spark, folder, folder + "-compact", retention_minutes=1)
    assert pipeline.read_buckets(spark, folder + "-compact").count() == 1
    assert pipeline.read_buckets(spark, folder, since_minute=1).count() == 1


def test_a_batch_run_again_changes_nothing(spark, traffic, tmp_path):
    _, rows = traffic
    folder = str(tmp_path / "again")
    for _ in range(2):
        pipeline.write_buckets(rows, 7, folder)
    assert pipeline.read_buckets(spark, folder).agg(F.sum("success") + F.sum("client_error") + F.sum("server_error") + F.sum("timeout")).first()[0] == rows.count()


def test_detector_state_survives_micro_batches(spark, traffic, tmp_path):
    path, rows = traffic
    known = anomaly.detector_table(spark, [anomaly.zscore_detector("d", "model")])
    want = sorted(map(tuple, anomaly.zscore_anomalies(rows, known).collect()))
    assert want
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    out = str(tmp_path / "found")
    pipeline.detect_stream(stream, known).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert [(g[0], round(g[6], 6)) for g in got] == [(w[0], round(w[6], 6)) for w in want]


def test_watermarked_windows_and_evaluation_trigger(spark, traffic, tmp_path):
    path, rows = traffic
    stream = spark.readStream.schema(rows.schema).parquet(path)
    q = pipeline.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("total")).first()[0] == rows.count()
    ticks = []
    with pytest.raises(windows.UnknownModel):
        windows.model_query(rows, "no such model", "1h", known_only=True)
    q = pipeline.evaluate_every(stream, str(tmp_path / "c4"), ticks.append, seconds=0)
    q.processAllAvailable()
    q.stop()
    assert ticks


def test_command_line(spark, tmp_path, capsys):
    out, conf = str(tmp_path / "sim"), yaml_file(tmp_path, GOOD)
    assert "6000 events" in cli.main(["simulate", "--out", out, "--rate", "100", "--model", "m", "--inject", "burst"], spark)
    row = json.loads(cli.main(["query", "--events", out, "--model", "m", "--window", "5m"], spark))
    assert row["total"] == 6000 and row["series"] == "inference{model=m}"
    assert "unknown model" in cli.main(["query", "--events", out, "--model", "x"], spark)
    assert {json.loads(line)["slo"] for line in cli.main(["evaluate", "--events", out, "--config", conf], spark).splitlines()} == {"a", "b"}
    args = ["serve", "--events", out, "--config", conf, "--home", str(tmp_path / "home"), "--checkpoint", str(tmp_path / "check"), "--once"]
    served = {r["slo"]: r for r in map(json.loads, cli.main(args, spark).splitlines())}
    batch = {r["slo"]: r for r in map(json.loads, cli.main(["evaluate", "--events", out, "--config", conf], spark).splitlines())}
    assert served["a"] == batch["a"] and set(served) == {"a", "b"}  # b's slow calls are the sketch's
    assert served["b"]["burn_rate_1h"] == pytest.approx(batch["b"]["burn_rate_1h"], rel=0.02)
    text = cli.main(["dashboard", "--events", out, "--config", conf, "--model", "m", "--times", "2", "--refresh-secs", "0"], spark)
    assert "inference{model=m}" in text and "b" in text
    assert "inference{" not in cli.main(["dashboard", "--events", out, "--model", "x"], spark)
    text = cli.main(["report", "--events", out, "--config", conf, "--title", "T", "--note", "n"], spark)
    assert "## T" in text and "- n" in text and "inference{model=m}" in text
    assert json.loads(cli.main(["bench", "--events", "10000"], spark))["successes"] > 9000
    capsys.readouterr()
    with pytest.raises(SystemExit):
        cli.main(["query"], spark)
