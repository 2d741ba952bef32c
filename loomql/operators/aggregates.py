"""Aggregates beyond the built-in ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_agg(value: str, order: str) -> Column:
    """array_agg(value ORDER BY order): keeps nulls (collect_list drops them, a struct does not)."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


@dataclass
class Aggregate:
    """A user-defined aggregate with partial states, run in two stages.

    ``step(state, batch)`` folds an Arrow batch of values (without nulls) into a list of doubles, ``combine`` merges two
    states, ``final`` gives the result (double). Each task reduces its batches to one state per
    key before the shuffle, so a hot key ships one small row per task.
    """

    zero: Callable[[], list[float]]
    step: Callable[[list[float], pd.Series], list[float]]
    combine: Callable[[list[float], list[float]], list[float]]
    final: Callable[[list[float]], float | None]

    def group(self, df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
        zero, step, combine, final = self.zero, self.step, self.combine, self.final
        schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)

        def partial(batches):
            states: dict[tuple, list[float]] = {}
            for b in batches:
                for key, rows in b.groupby(keys, dropna=False, sort=False):
                    key = key if isinstance(key, tuple) else (key,)
                    states[key] = step(states.get(key) or zero(), rows[value].dropna())
            yield pd.DataFrame([(*k, s) for k, s in states.items()], columns=[*keys, "_state"])

        def merge(key, rows):
            state = zero()
            for s in rows["_state"]:
                state = combine(state, list(s))
            return pd.DataFrame([(*key, final(state))], columns=[*keys, out])

        parts = df.select(*keys, value).mapInPandas(partial, f"{schema}, _state array<double>")
        return parts.groupBy(*keys).applyInPandas(merge, f"{schema}, `{out}` double")
