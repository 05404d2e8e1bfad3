"""Adapters, validators and sinks by name, the built-in ones and those that a project adds."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import defects
from spanloom.sources import tasks


class Named:
    """Functions by name. A name stands for one function; it can be given anew."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def register(self, name: str, function: Callable) -> Callable:
        self.known[name] = function
        return function

    def __getitem__(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"no {self.what} is called {name!r}; there are {', '.join(sorted(self.known)) or 'none'}")
        return self.known[name]

    def names(self) -> list[str]:
        return sorted(self.known)


#: (spark, path, **options) -> rows.
ADAPTERS = Named("adapter")
#: (spans, rows) -> violations, with task_id, row_index, field, type, pos and span at least.
VALIDATORS = Named("validator")
#: (rows, path) -> None.
SINKS = Named("sink")

ADAPTERS.register("jsonl", tasks.read_jsonl)
ADAPTERS.register("parquet", lambda spark, path: spark.read.parquet(path))
ADAPTERS.register("task_directory", tasks.read_task_directory)
VALIDATORS.register("verbatim", defects.non_verbatim)
VALIDATORS.register("punctuation", defects.trailing_punctuation)
VALIDATORS.register("repeated", lambda spans, rows: defects.repeated_spans(spans))
VALIDATORS.register("collision", lambda spans, rows: defects.type_collisions(spans))
SINKS.register("jsonl", tasks.write_training_data)
SINKS.register("parquet", lambda rows, path: rows.write.mode("error").parquet(path))


def violations(spans: DataFrame, rows: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """rule and the place of each violation that the validators of these names find, all by default."""
    out = None
    for name in VALIDATORS.names() if names is None else names:
        one = VALIDATORS[name](spans, rows).select(F.lit(name).alias("rule"), *defects.AT)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no validator is named")
    return out


def moved(spark, adapter: str, path: str, sink: str, to: str, **options) -> None:
    """What an adapter reads goes to a sink."""
    SINKS[sink](ADAPTERS[adapter](spark, path, **options), to)
