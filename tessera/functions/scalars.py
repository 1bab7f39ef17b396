"""Scalar expressions of the engine, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What states and stages are called; unknown ones show as they are.
STATE_LABELS = {
    "PENDING": "待执行 Pending", "SHARDING": "分片中 Sharding", "MAP": "Map 阶段 Map", "SHUFFLE": "Shuffle 阶段 Shuffle", "REDUCE": "Reduce 阶段 Reduce",
    "SUCCEEDED": "成功 Succeeded", "FAILED": "失败 Failed", "CANCELLED": "已取消 Cancelled", "ASSIGNED": "已分配 Assigned", "RUNNING": "运行中 Running",
    "RETRYING": "重试中 Retrying", "alive": "存活 Alive", "dead": "失联 Dead",
}
STAGE_LABELS = {"input": "输入分片 Input", "map": "Map 阶段 Map", "shuffle": "Shuffle 阶段 Shuffle", "reduce": "Reduce 阶段 Reduce"}
LEVEL_LABELS = {"DEBUG": "调试 DEBUG", "INFO": "信息 INFO", "WARN": "警告 WARN", "ERROR": "错误 ERROR"}


def round_half_up(x: Column, places: int) -> Column:
    """Rounded half away from zero in double arithmetic, one formula for Spark and SQL alike; numbers without such digits stay."""
    scale = float(10**places)
    return F.when(F.abs(x) * scale < 4e15, F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale).otherwise(x.cast("double"))


def to_double(c: Column) -> Column:
    """A value as double if it reads as a decimal or exponent number, NaN or an infinity; else null. Suffixes as in 12d don't read."""
    text = F.trim(c.cast("string"))
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    named = text.rlike(r"(?i)^[+-]?(nan|inf|infinity)$")
    return F.when(plain | named, text.try_cast("double"))


def exact_sum(v: Column) -> Column:
    """Sum of doubles that doesn't depend on their order: six decimal places exactly, values beyond that range as doubles; NaN is ignored."""
    v = F.when(~F.isnan(v), v)
    fits = F.abs(v) < 1e20
    fine = F.sum(F.when(fits, v).try_cast("decimal(28,6)")).cast("double")
    rest = F.sum(F.when(~fits, v))
    return F.when(rest.isNull(), fine).otherwise(F.coalesce(fine, F.lit(0.0)) + rest)


def sanitize(v: Column) -> Column:
    """A number as JSON holds it: NaN is null, infinities are 'inf' and '-inf'; below 1e16 no exponent for large ones."""
    plain = F.regexp_replace(v.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.isnan(v), None).when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").when((F.abs(v) >= 1e7) & (F.abs(v) < 1e16), plain).otherwise(v.cast("string"))


def clamp_number(raw: Column, default: float, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(to_double(raw), F.lit(float(default)))))


def clamp_integer(raw: Column, default: int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(to_double(raw).try_cast("bigint"), F.lit(default)))).cast("bigint")


def to_flag(raw: Column, default: bool = False) -> Column:
    """True for 1, true, yes and on."""
    return F.coalesce(F.lower(F.trim(raw.cast("string"))).isin("1", "true", "yes", "on"), F.lit(default))


def mean_or_zero(v: Column) -> Column:
    return F.coalesce(round_half_up(exact_sum(v) / F.count(v), 2), F.lit(0.0))


def padded_id(prefix: str, index: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(index.cast("string"), 4, "0"))


def index_of(name: Column) -> Column:
    """The number at the end of an id such as m-0007; null without one."""
    return F.regexp_extract(name, r"-([0-9]+)$", 1).try_cast("int")


def unique_id(prefix: str, ms: Column, *parts: Column) -> Column:
    """prefix-hexms-suffix; the suffix is a hash of the parts, so that reruns agree."""
    return F.concat(F.lit(f"{prefix}-"), F.lower(F.hex(ms)), F.lit("-"), F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 6))


def partition_file(index: Column) -> Column:
    return F.concat(padded_id("part", index), F.lit(".jsonl"))


def partition_index(file: Column) -> Column:
    return F.regexp_extract(file, r"part-([0-9]+)\.jsonl$", 1).try_cast("int")


def elapsed_ms(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0), now - then).cast("bigint")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.extract(F.lit("SECOND"), ts)
    return day * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(seconds * 1000).cast("bigint")


def clock(ms: Column) -> Column:
    """Date and time in UTC; '-' for 0 or null."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(ms / 1000).cast("decimal(18,6)"))
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "-").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def label(table: dict[str, str], value: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), value)


def fixed(x: Column, places: int) -> Column:
    """x with that many decimals, rounded half up, without grouping."""
    return F.format_string(f"%.{places}f", round_half_up(x, places))


def show_bytes(n: Column) -> Column:
    kb = 1024.0
    return F.when(n.isNull(), "-").when(n < kb, F.concat(n.cast("string"), F.lit(" B"))).when(n < kb**2, F.concat(fixed(n / kb, 1), F.lit(" KB"))).when(n < kb**3, F.concat(fixed(n / kb**2, 2), F.lit(" MB"))).otherwise(F.concat(fixed(n / kb**3, 2), F.lit(" GB")))


def show_duration(ms: Column) -> Column:
    return F.when(ms.isNull(), "-").when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(ms < 60000, F.concat(fixed(ms / 1000.0, 1), F.lit(" s"))).otherwise(F.concat(fixed(ms / 60000.0, 1), F.lit(" min")))


def show_percent(x: Column) -> Column:
    return F.when(x.isNull(), "-").otherwise(F.concat(fixed(x, 1), F.lit("%")))


def show_number(n: Column) -> Column:
    return F.when(n.isNull(), "-").otherwise(F.format_number(n, 0))


def value_cell(columns: list[str]) -> Column:
    """How a result record shows beside its key: its only value, or name=value pairs."""
    rest = [c for c in columns if c != "key"]
    if len(rest) == 1:
        return F.col(rest[0]).cast("string")
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in rest])
