"""Aggregates of a caller's own: a state that is made, fed, merged and finished.

Each task feeds states for its own rows, in Arrow batches, and sends one pickled state for each group that it
has seen; the states of a group meet and are merged. So a group costs a row a task, however large it is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of a task whose states are held before they are sent on.
HELD_GROUPS = 50_000


class AggregateState(Protocol):
    """Anything that pickles and has these. ``add`` gets the values of one group as a series, nulls included."""

    def new(self) -> Any: ...
    def add(self, state: Any, values: pd.Series) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> Any: ...


def aggregate(df: DataFrame, keys: Sequence[str], column: str, by: AggregateState, kind: str, alias: str) -> DataFrame:
    """(keys, alias): ``by`` over ``column`` in each group, as SQL type ``kind``. Without keys there is one group,
    and one row even for no rows: the finished new state."""
    keyed = df.select(*[F.col(k) for k in keys], F.col(column).alias("__value"))
    if not keys:
        keyed = keyed.withColumn("__all", F.lit(0))
    names = list(keys) or ["__all"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*names).schema)

    def fed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Any] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*k, pickle.dumps(v)) for k, v in states.items()], columns=[*names, "__state"])

        for frame in frames:
            for key, values in frame.groupby(names, dropna=False, sort=False)["__value"]:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                states[key] = by.add(states[key] if key in states else by.new(), values)
            if len(states) > HELD_GROUPS:
                yield out()
                states.clear()
        yield out()

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        state = by.new()
        for held in frame["__state"]:
            state = by.merge(state, pickle.loads(held))
        return pd.DataFrame([(*key, by.finish(state))], columns=[*names, alias])

    got = keyed.mapInPandas(fed, f"{fields}, __state binary").groupBy(*names).applyInPandas(merged, f"{fields}, `{alias}` {kind}")
    if keys:
        return got
    # One group gathers a state a task; without any row the new state answers.
    empty = df.sparkSession.createDataFrame([(0, by.finish(by.new()))], f"__all int, `__zero` {kind}")
    return empty.join(got, "__all", "left").select(F.coalesce(F.col(alias), F.col("__zero")).alias(alias))
