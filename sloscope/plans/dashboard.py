"""Golden signals and objectives as rows, and as a text report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloscope.functions import scalars as S
from sloscope.operators import windows
from sloscope.operators.windows import Minute

WINDOW, QUANTILE = "5m", 0.95


def golden_signals(events: DataFrame, as_of_minute: Minute | None = None, window: str = WINDOW, quantile: float = QUANTILE, model: str | None = None) -> DataFrame:
    """Each series' snapshot with its health by success and by latency; unknown where there was nothing.

    With ``model`` only series that have it among their labels.
    """
    shot = windows.window_query(events, window, quantile, as_of_minute)
    if model is not None:
        shot = shot.filter(F.col("model") == model)
    return shot.select(S.series_text().alias("series"), *[c for c in shot.columns if c != "series"], S.success_health(F.col("success_ratio")).alias("success_health"), S.latency_health(F.col("latency_quantile_ms")).alias("latency_health"))


def slo_panel(evaluations: DataFrame) -> DataFrame:
    """One line of text for each objective, and its first alert."""
    alert = F.try_element_at("alerts", F.lit(1))
    shown = F.when(alert.isNull(), "—").otherwise(F.format_string("%s %.1f×/%.1f×", alert["severity"], alert["long_burn_rate"], alert["short_burn_rate"]))
    return evaluations.select(
        "slo", F.format_string("%.3f", "objective").alias("objective"), F.format_string("%.2f", "burn_rate_1h").alias("burn_1h"),
        F.format_string("%.2f", "burn_rate_full_window").alias("burn_full"), F.format_string("%5.1f%%", F.col("budget_remaining") * 100).alias("budget"), shown.alias("alert"),
    )


def model_rollup(events: DataFrame) -> DataFrame:
    """Extension: totals by model and region, by model, and of all, with tokens and cost."""
    rows = events.select("model", F.try_element_at("metadata", F.lit("region")).alias("region"), "status", "input_tokens", "output_tokens", "cost_usd")
    sums = [F.count("*").alias("total"), F.count_if(S.is_good()).alias("good"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd")]
    return rows.rollup("model", "region").agg(F.grouping_id().cast("long").alias("level"), *sums)


def as_text(rows: DataFrame, most: int = 200) -> str:
    """The first rows as a table, for a terminal, and a line that says so where there are more."""
    got = rows.limit(most + 1).collect()
    more, got = len(got) > most, got[:most]
    table = [rows.columns, *[["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in got]]
    widths = [max(len(r[k]) for r in table) for k in range(len(rows.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in table]
    return "\n".join([*lines, f"... more than {most} rows"] if more else lines)
