"""Map side: functions from a DataFrame to rows (key, value), all native expressions.

Text mappers read a column `text`; a null text has no words. kv reads `key` and `value`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import to_double

#: Fixed value: what separates words. Letters with accents do, CJK ideographs don't.
SEPARATORS = "[^a-zA-Z0-9一-鿿]+"
#: Fixed value: the same code points listed, not excluded; Java's matcher takes a fraction of the time over these.
LISTED_SEPARATORS = r"[\x00-/:-@\[-`{-\u4dff\ua000-\x{10ffff}]+"
DEFAULT_PATTERN = "map"


def words(text: Column) -> Column:
    return F.split(F.lower(text), LISTED_SEPARATORS)


def _tokens(df: DataFrame, text: str, once: bool = False) -> DataFrame:
    found = words(F.col(text))
    return df.select(F.explode(F.array_distinct(found) if once else found).alias("key")).where("key <> ''")


def wordcount(df: DataFrame, text: str = "text", **_) -> DataFrame:
    """(word, 1) for each word."""
    return _tokens(df, text).withColumn("value", F.lit(1).cast("bigint"))


def word_length(df: DataFrame, text: str = "text", **_) -> DataFrame:
    """(word, its length in code points) for each word."""
    return _tokens(df, text).withColumn("value", F.length("key").cast("bigint"))


def grep(df: DataFrame, text: str = "text", pattern: str = DEFAULT_PATTERN, **_) -> DataFrame:
    """(pattern, 1) for each record that contains the pattern literally, in any case; no match, no row."""
    needle = pattern.lower()
    return df.where(F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(needle))).select(F.lit(needle).alias("key"), F.lit(1).cast("bigint").alias("value"))


def kv(df: DataFrame, key: str = "key", value: str = "value", **_) -> DataFrame:
    """(key, number); a missing key is 'unknown', a value that is no number 0, NaN null."""
    kind = dict(df.dtypes)[value]
    number = F.col(value).cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else to_double(F.col(value))
    number = F.coalesce(number, F.lit(0.0))
    return df.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key"), F.when(~F.isnan(number), number).alias("value"))


def distinct(df: DataFrame, text: str = "text", **_) -> DataFrame:
    """(word, 1) once for each record that has it."""
    return _tokens(df, text, once=True).withColumn("value", F.lit(1).cast("bigint"))
