"""What a caller brings: metrics by name, quantities as expressions, policies as functions of a frontier."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.dimension import MASS_SLACK


class Registry:
    """Metrics by name; a name registers once."""

    def __init__(self) -> None:
        self.metrics: dict[str, tuple[str, str, str, int]] = {}

    def register(self, name: str, *, family: str, direction: str, version: int) -> None:
        if direction not in ("up", "down"):
            raise ValueError("direction is up or down")
        if name in self.metrics:
            raise ValueError(f"{name} is registered")
        self.metrics[name] = (name, family, direction, version)

    def family(self, name: str) -> list[str]:
        return sorted(m for m, f, _, _ in self.metrics.values() if f == name)

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row for each metric: as few as were registered by hand."""
        return spark.createDataFrame(sorted(self.metrics.values()), "metric string, family string, direction string, version int")


def measurements(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], sample_size: str, registry: Registry) -> DataFrame:
    """Aggregates as long rows; a metric that is not registered is an error, one without a value has no row."""
    if unknown := set(metrics) - set(registry.metrics):
        raise ValueError(f"not registered: {sorted(unknown)}")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    out = rows.select(*keys, F.explode(pairs).alias("m"), F.col(sample_size).alias("sample_size"))
    return out.filter("m.value is not null").select(*keys, "m.metric", "m.value", "sample_size")


def compared(rows: DataFrame, quantity: Column, side: str) -> DataFrame:
    """Mean of a quantity on each side over the rows that have something to say about it."""
    said = rows.select(F.col(side).alias("side"), quantity.alias("q")).filter("q is not null")
    return said.groupBy("side").agg(F.count("*").alias("games"), F.avg("q").alias("value"))


Policy = Callable[[list], list[dict]]


def played(policy: Policy, rows: int = 1024) -> Callable[[DataFrame], DataFrame]:
    """An ``expand`` for ``mass_ledger`` from a function of a batch of states to a distribution ``{next: share}`` for each.

    The function is called in the tasks that hold the frontier, on up to ``rows`` states at a time. The job fails if a
    batch comes back with another number of distributions, or with a share below 0 or not finite, or over 1 in sum.
    """

    def expand(frontier: DataFrame) -> DataFrame:
        kind = frontier.schema["state"].dataType

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                arrow = b.schema.field("state").type
                for at in range(0, b.num_rows, rows):
                    states = b.slice(at, rows).column("state").to_pylist()
                    given = list(policy(states))
                    if len(given) != len(states):
                        raise ValueError(f"the policy gave {len(given)} distributions for {len(states)} states")
                    for state, d in zip(states, given):
                        if any(not (math.isfinite(p) and p >= 0) for p in d.values()) or sum(d.values()) > 1 + MASS_SLACK:
                            raise ValueError(f"not a distribution for state {state!r}")
                    flat = [(s, n, float(p)) for s, d in zip(states, given) for n, p in d.items()]
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], arrow), pa.array([f[1] for f in flat], arrow), pa.array([f[2] for f in flat], pa.float64())], ["state", "next", "p"])

        return frontier.select("state").mapInArrow(ask, T.StructType().add("state", kind).add("next", kind).add("p", T.DoubleType()))

    return expand
