"""A register of transforms and scorers that others add, each with its declared input and output columns.

A scorer adds one struct (entities, intent, gravity, confidence); the scorers' structs of a row are merged: means of gravity and confidence, the intent of most, all entities.
What can't be planned (a missing input, a failing function) is left out and named in `failures`; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "struct<entities:array<string>,intent:string,gravity:double,confidence:double>"


@dataclass
class Plugin:
    name: str
    inputs: tuple[str, ...]
    function: Callable[[], Column]


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, *inputs: str) -> Callable:
        """Add a scorer: a function without arguments that gives a Column of RESULT over the declared inputs."""

        def add(function: Callable[[], Column]) -> Callable[[], Column]:
            if name in self.plugins:
                raise ValueError(f"{name} is registered already")
            self.plugins[name] = Plugin(name, inputs, function)
            return function

        return add

    def detach(self, name: str) -> None:
        self.plugins.pop(name, None)

    def scored(self, df: DataFrame) -> DataFrame:
        """df with `result`, the merged RESULT of all scorers that fit it; null where none gives one."""
        self.failures, parts = {}, []
        for p in self.plugins.values():
            missing = [c for c in p.inputs if c not in df.columns]
            try:
                if missing:
                    raise ValueError(f"missing columns: {', '.join(missing)}")
                part = p.function().cast(RESULT)
                df.select(part)  # analysed now, so that a wrong plan is this scorer's failure only
                parts.append(part)
            except Exception as e:  # noqa: BLE001  whatever a foreign function raises
                self.failures[p.name] = str(e)
        if not parts:
            return df.withColumn("result", F.lit(None).cast(RESULT))
        return df.withColumn("result", merged(F.filter(F.array(*parts), lambda r: r.isNotNull())))


def merged(results: Column) -> Column:
    """One RESULT of an array of them. Of equally frequent intents the first by name; null of an empty array."""
    mean = lambda name: F.aggregate(results, F.lit(0.0), lambda s, r: s + F.coalesce(r[name], F.lit(0.0)), lambda s: s / F.size(results))
    intents = F.array_sort(F.filter(F.transform(results, lambda r: r["intent"]), lambda i: i.isNotNull()))
    votes = F.transform(F.array_distinct(intents), lambda i: F.struct((-F.size(F.filter(intents, lambda j: j == i))).alias("n"), i.alias("intent")))
    entities = F.array_sort(F.array_distinct(F.flatten(F.transform(results, lambda r: F.coalesce(r["entities"], F.array().cast("array<string>"))))))
    whole = F.struct(entities.alias("entities"), F.array_min(votes)["intent"].alias("intent"), mean("gravity").alias("gravity"), mean("confidence").alias("confidence"))
    return F.when(F.size(results) > 0, whole)
