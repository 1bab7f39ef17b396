"""Engine settings: parsed, clamped, merged, and as Spark configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """A setting that doesn't parse keeps its default; one out of range is moved to the nearest bound."""

    shuffle_partitions: int = 200
    max_attempts: int = 4
    speculation: bool = True
    straggler_threshold: float = 2.0
    heartbeat_timeout_sec: float = 80.0
    backoff_base_ms: int = 1000
    input_rows: int = 12_000
    seed: int = 42

    def updated(self, **changes) -> EngineConfig:
        """These settings with the changes merged in; absent ones stay, unknown ones are ignored."""
        known = {f.name: f for f in fields(self)}
        return replace(self, **{k: parsed(k, v, getattr(self, k)) for k, v in changes.items() if k in known})

    def spark_settings(self) -> dict[str, str]:
        """How Spark is told: retries, speculation, adaptive plans."""
        return {
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions),
            "spark.task.maxFailures": str(self.max_attempts),
            "spark.speculation": str(self.speculation).lower(),
            "spark.speculation.multiplier": str(self.straggler_threshold),
            "spark.network.timeout": f"{max(1, round(self.heartbeat_timeout_sec))}s",
        }


BOUNDS = {"shuffle_partitions": (1, 1_000_000), "max_attempts": (1, 100), "straggler_threshold": (1.0, 100.0), "heartbeat_timeout_sec": (1.0, 86_400.0), "backoff_base_ms": (0, 3_600_000), "input_rows": (1, 10_000_000), "seed": (0, 2**31 - 1)}


def parsed(name: str, raw: object, default: int | float | bool) -> int | float | bool:
    if isinstance(default, bool):
        return raw if isinstance(raw, bool) else str(raw).strip().lower() in ("1", "true", "yes", "on")
    try:
        value = type(default)(float(raw))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return default
    low, high = BOUNDS[name]
    return default if value != value else max(low, min(high, value))
