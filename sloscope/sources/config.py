"""YAML configuration: retention, evaluation cadence and objectives."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sloscope.functions.scalars import MINUTE_NANOS, parse_duration


class ConfigError(ValueError):
    """The configuration is missing, malformed or holds an impossible objective."""


#: Fixed values of the configuration format.
LISTEN, RETENTION_MINUTES, EVAL_INTERVAL_SECS, LATENCY_QUANTILE = "127.0.0.1:9090", 1440, 10, 0.95
KINDS = ("success_ratio", "latency_threshold")

SLO_SCHEMA = "name string, model string, sli_kind string, threshold_ms double, quantile double, objective double, window string, window_nanos decimal(20,0)"


@dataclass(frozen=True)
class Slo:
    """One objective; ``quantile`` is carried and not used, the threshold's share of events is what counts."""

    name: str
    model: str
    objective: float
    window: str
    sli_kind: str = "success_ratio"
    threshold_ms: float | None = None
    quantile: float | None = None

    @property
    def window_nanos(self) -> int:
        """0 (the current bucket alone) for a window that can't be read, which only a lenient load lets through."""
        return parse_duration(self.window) or 0


@dataclass(frozen=True)
class Config:
    listen: str = LISTEN
    wal_path: str = ""
    retention_minutes: int = RETENTION_MINUTES
    eval_interval_secs: int = EVAL_INTERVAL_SECS
    slos: tuple[Slo, ...] = field(default=())

    @property
    def longest_minutes(self) -> int:
        """Minutes of the longest objective's window."""
        return max((s.window_nanos // MINUTE_NANOS for s in self.slos), default=0)


def _slo(raw: dict, lenient: bool) -> Slo:
    try:
        sli = raw["sli"]
        kind = sli["kind"]
        slo = Slo(
            str(raw["name"]), str(raw["model"]), float(raw["objective"]), str(raw["window"]), kind,
            float(sli["threshold_ms"]) if kind == "latency_threshold" else None,
            float(sli.get("quantile", LATENCY_QUANTILE)) if kind == "latency_threshold" else None,
        )
    except (KeyError, TypeError, ValueError) as e:
        raise ConfigError(f"malformed objective {raw!r}: {e}") from e
    if kind not in KINDS:
        raise ConfigError(f"unknown sli kind {kind!r}")
    if not lenient and parse_duration(slo.window) is None:
        raise ConfigError(f"{slo.name}: {slo.window!r} is not a window")
    return slo


def load_config(path: str = "", lenient: bool = False) -> Config:
    """The file's configuration; defaults for what it leaves out, and for an empty path."""
    if not path:
        return Config()
    import yaml

    try:
        raw = yaml.safe_load(Path(path).read_text()) or {}
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(str(e)) from e
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    try:
        return Config(
            str(raw.get("listen", LISTEN)), str(raw.get("wal_path", "")), int(raw.get("retention_minutes", RETENTION_MINUTES)),
            int(raw.get("eval_interval_secs", EVAL_INTERVAL_SECS)), tuple(_slo(x, lenient) for x in raw.get("slos") or ()),
        )
    except (TypeError, ValueError) as e:
        raise e if isinstance(e, ConfigError) else ConfigError(str(e))


def slo_table(spark: SparkSession, slos: tuple[Slo, ...] | list[Slo]) -> DataFrame:
    """The objectives as rows; as many as the configuration has."""
    from decimal import Decimal

    rows = [(s.name, s.model, s.sli_kind, s.threshold_ms, s.quantile, s.objective, s.window, Decimal(s.window_nanos)) for s in slos]
    return spark.createDataFrame(rows, SLO_SCHEMA)
