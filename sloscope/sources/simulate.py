"""Synthetic traffic with injected faults, generated in parallel from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.sources.events import empty_metadata

SCENARIOS = ("baseline", "burst", "drift", "tail-latency", "rollout")
#: Fixed values of the traffic model.
MU, SIGMA = 4.4, 0.4
BASE_ERRORS, BURST_ERRORS, CLIENT_ERRORS, SERVER_SHARE = 0.001, 0.35, 0.005, 0.6
TOKEN_PRICE = 2e-6


def simulate(
    spark: SparkSession, rate: int = 1000, duration_secs: int = 60, model: str = "model", version: str = "v1", scenario: str = "baseline", seed: int = 1, start_nanos: int = 0, partitions: int | None = None
) -> DataFrame:
    """``rate`` events a second for ``duration_secs`` seconds, as events; the same for one seed and partitioning."""
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}")
    count = rate * duration_secs
    rows = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    elapsed = F.col("id") / F.lit(float(rate))
    frac = elapsed / F.lit(float(max(1, duration_secs)))
    rows = rows.select("id", elapsed.alias("elapsed"), frac.alias("frac"), F.exp(F.lit(MU) + F.lit(SIGMA) * F.randn(seed)).alias("latency"), *[F.rand(seed + k).alias(f"u{k}") for k in range(1, 7)])
    latency, errors, named = F.col("latency"), F.lit(BASE_ERRORS), F.lit(version)
    if scenario == "burst":
        errors = F.when((F.col("frac") >= 0.2) & (F.col("frac") < 0.4), BURST_ERRORS).otherwise(BASE_ERRORS)
    elif scenario == "drift":
        latency = latency * (1 + 2 * F.least(F.col("frac"), F.lit(1.0)))
    elif scenario == "tail-latency":
        latency = F.when(F.col("u4") < 0.01, latency * 10).otherwise(latency)
    elif scenario == "rollout":
        named = F.when(F.col("elapsed") >= duration_secs / 2, f"{version}-new").otherwise(version)
    status = F.when(F.col("u1") < errors, F.when(F.col("u2") < SERVER_SHARE, "server_error").otherwise("timeout")).when(F.col("u3") < CLIENT_ERRORS, "client_error").otherwise("success")
    tokens_in, tokens_out = F.floor(50 + F.col("u5") * 750).cast("long"), F.floor(F.col("u6") * 200).cast("long")
    return rows.select(
        F.col("id").alias("arrival_seq"), (F.lit(start_nanos) + (F.col("elapsed") * 1_000_000_000).cast("long")).alias("ts_nanos"), F.lit(model).alias("model"), named.alias("model_version"),
        latency.alias("latency_ms"), status.alias("status"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"),
        ((tokens_in + 2 * tokens_out).cast("double") * TOKEN_PRICE).alias("cost_usd"), empty_metadata().alias("metadata"),
    )
