"""Named mappers and reducers, jobs made of one of each, and the presets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions import mappers as m
from . import reducers as r

Mapper = Callable[..., DataFrame]
Reducer = Callable[[DataFrame], DataFrame]


class Registry:
    """Functions by name, with descriptions; an unknown name raises KeyError and lists those there are."""

    def __init__(self, kind: str):
        self.kind, self.functions, self.descriptions = kind, {}, {}

    def register(self, name: str, function: Callable, description: str = "") -> None:
        self.functions[name], self.descriptions[name] = function, description

    def get(self, name: str) -> Callable:
        if name not in self.functions:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(self.names())}")
        return self.functions[name]

    def has(self, name: str) -> bool:
        return name in self.functions

    def names(self) -> list[str]:
        return sorted(self.functions)

    def listing(self) -> list[dict[str, str]]:
        return [{"name": n, "description": self.descriptions[n]} for n in self.names()]


MAPPERS, REDUCERS = Registry("mapper"), Registry("reducer")
for _name, _f in (("wordcount_mapper", m.wordcount), ("word_length_mapper", m.word_length), ("grep_mapper", m.grep), ("kv_mapper", m.kv), ("distinct_mapper", m.distinct)):
    MAPPERS.register(_name, _f, _f.__doc__ or "")
for _name, _f in (("count_reducer", r.count), ("stats_reducer", r.stats), ("sum_reducer", r.total), ("extremes_reducer", r.extremes)):
    REDUCERS.register(_name, _f, _f.__doc__ or "")

def python_mapper(function: Callable[[list[dict], dict], list[tuple]], value_type: str = "double") -> Mapper:
    """A mapper from a plain function (records, params) -> [(key, value)]; it gets Arrow batches of records, so it must be stateless."""

    def mapper(df: DataFrame, **params) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame(function(frame.to_dict("records"), params), columns=["key", "value"])

        return df.mapInPandas(run, f"key string, value {value_type}")

    return mapper


def python_reducer(function: Callable[[str, list], dict], schema: StructType | str) -> Reducer:
    """A reducer from a plain function (key, values) -> record. A key's values meet in one task's memory: for keys of bounded size."""

    def reducer(df: DataFrame) -> DataFrame:
        return df.groupBy("key").applyInPandas(lambda key, frame: pd.DataFrame([function(key[0], frame["value"].tolist())]), schema)

    return reducer


#: The kind of input each mapper reads; others read word text.
INPUT_KINDS = {"wordcount_mapper": "wordcount", "word_length_mapper": "word_length", "grep_mapper": "grep", "kv_mapper": "kv", "distinct_mapper": "distinct"}


def input_kind(mapper: str) -> str:
    return INPUT_KINDS.get(mapper, "wordcount")


@dataclass(frozen=True)
class Job:
    """A named query: a mapper, a reducer, their parameters and its partition counts."""

    name: str
    mapper: str
    reducer: str = "count_reducer"
    params: dict = field(default_factory=dict)
    input_rows: int = 12_000
    num_map_tasks: int = 8
    num_reduce_tasks: int = 4

    def __post_init__(self):
        MAPPERS.get(self.mapper), REDUCERS.get(self.reducer)
        for name in ("input_rows", "num_map_tasks", "num_reduce_tasks"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a whole number of 1 or more")

    @property
    def map_tasks(self) -> int:
        """Never more tasks than rows."""
        return min(self.num_map_tasks, self.input_rows)


PRESETS = {
    j.name: j
    for j in (
        Job("term frequency", "wordcount_mapper", "count_reducer"),
        Job("word length", "word_length_mapper", "stats_reducer"),
        Job("text search", "grep_mapper", "count_reducer", {"pattern": "map"}, 8_000, 6, 2),
        Job("key-value sums", "kv_mapper", "sum_reducer", {}, 15_000, 8, 3),
        Job("document frequency", "distinct_mapper", "count_reducer", {}, 6_000, 6, 3),
    )
}


def preset(name: str) -> Job:
    if name not in PRESETS:
        raise KeyError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]


def run_job(df: DataFrame, mapper: str, reducer: str, **params) -> DataFrame:
    """The reduced result of a mapper over df. Registered functions of the user's own take and return DataFrames alike."""
    return REDUCERS.get(reducer)(MAPPERS.get(mapper)(df, **params))
