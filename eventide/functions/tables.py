"""Python table functions: machines of the streamed folds, callable from SQL with PARTITION BY and ORDER BY."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators.streams import Peaks


def peak_strategies(strategies: Sequence[tuple[str, float, float]]):
    """A table function over ``(key long, t long, value double)``: a row ``(key, strategy, t, value)`` for each peak of each strategy ``(name, threshold, valley)``.

    Call it with PARTITION BY the key and ORDER BY time. A partition's rows stream through one machine for each strategy; nothing else is kept.
    """

    @udtf(returnType="key: bigint, strategy: string, t: bigint, value: double")
    class PeakStrategies:
        def __init__(self):
            self.key = None
            self.machines = [(name, Peaks(threshold, valley)) for name, threshold, valley in strategies]

        def eval(self, row: Row):
            self.key = row["key"]
            for name, machine in self.machines:
                for t, value in machine.feed(row["t"], row["value"]):
                    yield self.key, name, t, value

        def terminate(self):
            for name, machine in self.machines:
                for t, value in machine.close():
                    yield self.key, name, t, value

    return PeakStrategies


def register(spark: SparkSession, strategies: Sequence[tuple[str, float, float]], name: str = "peak_strategies") -> None:
    """Make peak_strategies callable as a SQL table function of that name."""
    spark.udtf.register(name, peak_strategies(strategies))
