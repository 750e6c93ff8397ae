"""Command line: serve, dashboard, evaluate, query, report, simulate, bench.

Events are a Parquet folder with the event columns, a journal file or folder
(``--format journal``), or the generic ``events`` table (``--format table``).
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.functions import scalars as S
from sloscope.operators import anomaly, buckets, incident, slo, windows
from sloscope.plans import dashboard
from sloscope.session import session
from sloscope.sources import config, events, journal, simulate
from sloscope.streaming import pipeline, store


def read_events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "journal":
        journal.register(spark)
        frames = spark.read.format("journal").load(path)
        return events.parse_events(frames.withColumnRenamed("seq", "arrival_seq"))
    rows = spark.read.parquet(path)
    return events.from_event_table(rows) if kind == "table" else rows


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sloscope", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, doc: str, source: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=doc)
        if source:
            p.add_argument("--events", required=True)
            p.add_argument("--format", choices=("parquet", "journal", "table"), default="parquet")
            p.add_argument("--as-of-minute", type=int)
        return p

    p = add("serve", "ingest a folder of Parquet events as they come, detect, and evaluate a configuration", source=False)
    p.add_argument("--events", required=True)
    p.add_argument("--config", default="")
    p.add_argument("--home", required=True, help="where store, journal, anomalies and evaluations go")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--cap", type=int, default=10_000, help="series that are admitted")
    p.add_argument("--once", action="store_true", help="take what is there, evaluate once and end")
    p = add("dashboard", "golden signals and objectives")
    p.add_argument("--config", default="")
    p.add_argument("--model")
    p.add_argument("--refresh-secs", type=float, default=5.0)
    p.add_argument("--times", type=int, default=1, help="how often it is shown; 0 without end")
    p = add("evaluate", "objectives and alerts of a configuration")
    p.add_argument("--config", required=True)
    p = add("query", "a model's rolling window")
    p.add_argument("--model", required=True)
    p.add_argument("--window", default="1h")
    p.add_argument("--quantile", type=float, default=0.95)
    p = add("report", "golden signals, objectives, and an incident report")
    p.add_argument("--config", default="")
    p.add_argument("--title")
    p.add_argument("--note", action="append", default=[])
    p = add("simulate", "synthetic events", source=False)
    p.add_argument("--out", required=True)
    p.add_argument("--rate", type=int, default=1000)
    p.add_argument("--duration-secs", type=int, default=60)
    p.add_argument("--model", default="model")
    p.add_argument("--version", default="v1")
    p.add_argument("--inject", choices=simulate.SCENARIOS, default="baseline")
    p.add_argument("--seed", type=int, default=1)
    p = add("bench", "bucket building over simulated events", source=False)
    p.add_argument("--events", type=int, default=1_000_000)
    p.add_argument("--models", type=int, default=8)
    return parser


def serve(spark: SparkSession, a: argparse.Namespace) -> str:
    """The streams of ``pipeline.serve`` under a configuration; with ``--once`` its first evaluation, too."""
    known = config.load_config(a.config)
    slos = config.slo_table(spark, known.slos)
    stream = spark.readStream.schema(spark.read.parquet(a.events).schema).parquet(a.events)
    trigger = {"availableNow": True} if a.once else {"processingTime": "1 second"}
    running = pipeline.serve(stream, anomaly.detectors_for(slos), a.home, a.checkpoint, a.cap, **trigger)
    if not a.once:
        running.append(pipeline.serve_evaluations(spark, slos, a.home, f"{a.checkpoint}/evaluations", seconds=known.eval_interval_secs))
    for query in running:
        query.awaitTermination()
    return "\n".join(slo.evaluation_of(store.stored_budgets(spark, f"{a.home}/store", slos)).toJSON().collect())


def shown(spark: SparkSession, a: argparse.Namespace) -> str:
    """The dashboard of the events as they are now."""
    found = read_events(spark, a.events, a.format)
    known = config.load_config(a.config)
    slos = config.slo_table(spark, known.slos)
    if a.model is not None:
        slos = slos.filter(F.col("model") == a.model)
    panel = dashboard.slo_panel(slo.evaluate(found, slos, as_of_minute=a.as_of_minute, longest=known.longest_minutes))
    return "\n\n".join((dashboard.as_text(dashboard.golden_signals(found, a.as_of_minute, model=a.model)), dashboard.as_text(panel)))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = build_parser().parse_args(args)
    spark = spark or session()
    if a.command == "simulate":
        made = simulate.simulate(spark, a.rate, a.duration_secs, a.model, a.version, a.inject, a.seed)
        made.write.mode("overwrite").parquet(a.out)
        text = f"{a.rate * a.duration_secs} events in {a.out}"
    elif a.command == "bench":
        made = simulate.simulate(spark, a.events, 1).withColumn("model", F.concat(F.lit("model-"), (F.col("arrival_seq") % a.models).cast("string")))
        began = time.perf_counter()
        rows = buckets.minute_buckets(made).agg(F.sum("success")).first()[0]
        took = time.perf_counter() - began
        text = json.dumps({"events": a.events, "successes": rows, "seconds": round(took, 3), "events_per_second": round(a.events / took)})
    elif a.command == "serve":
        text = serve(spark, a)
    elif a.command == "dashboard":
        text, turn = shown(spark, a), 1
        while turn != a.times:
            print(text, end="\n\n", flush=True)
            time.sleep(a.refresh_secs)
            text, turn = shown(spark, a), turn + 1
    else:
        found = read_events(spark, a.events, a.format)
        if a.command == "query":
            try:
                text = "\n".join(windows.model_query(found, a.model, a.window, a.quantile, a.as_of_minute, known_only=True).withColumn("series", S.series_text()).toJSON().collect())
            except windows.UnknownModel:
                text = f"unknown model {a.model!r}"
        else:
            known = config.load_config(a.config)
            slos = config.slo_table(spark, known.slos)
            evaluations = slo.evaluate(found, slos, as_of_minute=a.as_of_minute, longest=known.longest_minutes)
            if a.command == "evaluate":
                text = "\n".join(evaluations.toJSON().collect())
            else:
                seen = anomaly.ring(anomaly.detect(found, anomaly.detectors_for(slos)))
                context = incident.incident_context(evaluations, seen, a.note, a.title)
                text = "\n\n".join((dashboard.as_text(dashboard.golden_signals(found, a.as_of_minute)), dashboard.as_text(dashboard.slo_panel(evaluations)), incident.summarise(context)))
    print(text)
    return text


if __name__ == "__main__":
    main()
