"""Aggregators of a user's own code, as mergeable partial states.

Three functions over numpy arrays say what an aggregator does: `add` turns values into states, `merge` puts states together,
`result` gives the value of each state; groups are numbered 0 .. n - 1 in each call. Each task keeps one state for each
group that it meets, up to a bound beyond which it hands them on, so that what is shuffled is one row for each group and task. After the shuffle
the states of a group stand side by side and are merged as they stream by, never held all at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Groups whose states a task holds before it hands them on.
HELD_GROUPS = 200_000


@dataclass(frozen=True)
class MergeableStates:
    """A state is `width` doubles. add(group, values, n) and merge(group, states, n) return n states; result(states) one value each, NaN for none."""

    width: int
    add: Callable[[np.ndarray, np.ndarray, int], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray, int], np.ndarray]
    result: Callable[[np.ndarray], np.ndarray]

    def aggregate(self, rows: DataFrame, keys: list[str], held: int = HELD_GROUPS) -> DataFrame:
        """(keys, value) of rows (keys, value); null and NaN values do not count, groups without any are left out."""
        rows = rows.select(*keys, rows["value"].cast("double").alias("value"))
        fields = rows.select(*keys).schema.fields
        schema = T.StructType([*fields, T.StructField("_state", T.ArrayType(T.DoubleType()))])
        partial = rows.where("value is not null").mapInPandas(self._partial(keys, held), schema)
        ordered = partial.repartition(*keys).sortWithinPartitions(*keys)
        return ordered.mapInPandas(self._merged(keys), T.StructType([*fields, T.StructField("value", T.DoubleType())]))

    def _grouped(self, pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
        """(group of each row, the groups' keys), in the order of the keys' first rows; null keys are one group."""
        if len(keys) == 1:
            code = pd.factorize(pdf[keys[0]], use_na_sentinel=False)[0]
        else:
            code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(code, return_index=True)[1]
        return code, pdf[keys].iloc[first].reset_index(drop=True)

    def _partial(self, keys: list[str], held: int):
        def rows_of(known: pd.DataFrame, states: np.ndarray) -> pd.DataFrame:
            return known.assign(_state=list(states))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, states = None, np.zeros((0, self.width))
            for pdf in frames:
                pdf = pdf[pdf["value"].notna()]
                if not len(pdf):
                    continue
                code, own = self._grouped(pdf, keys)
                fresh = np.asarray(self.add(code, pdf["value"].to_numpy(float), len(own)), float)
                if known is None:
                    known, states = own, fresh
                else:
                    both = pd.concat([known, own], ignore_index=True)
                    code, known = self._grouped(both, keys)
                    states = np.asarray(self.merge(code, np.concatenate([states, fresh]), len(known)), float)
                if len(known) > held:
                    yield rows_of(known, states)
                    known = None
            if known is not None and len(known):
                yield rows_of(known, states)

        return run

    def _merged(self, keys: list[str]):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            open_keys, open_states = None, None
            for pdf in frames:
                if open_keys is not None:  # the last group of the frame before may go on
                    pdf = pd.concat([open_keys.assign(_state=list(open_states)), pdf], ignore_index=True)
                if not len(pdf):
                    continue
                code, own = self._grouped(pdf, keys)
                states = np.asarray(self.merge(code, np.array(pdf["_state"].tolist(), float).reshape(len(pdf), self.width), len(own)), float)
                open_keys, open_states = own.iloc[-1:], states[-1:]
                if len(own) > 1:
                    yield own.iloc[:-1].assign(value=self.result(states[:-1]))
            if open_keys is not None:
                yield open_keys.assign(value=self.result(open_states))

        return run


def sums(group: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Column sums of each group: a building block of `add` and `merge`."""
    return np.stack([np.bincount(group, c, n) for c in columns.T], axis=1)
