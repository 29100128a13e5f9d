"""Packing of a key's snapshots into calls over slices, for keys with very many snapshots.

The greedy rule is a machine whose state is the points of the open call. A slice of a key's snapshots is then a map: for every
number of points that the call before may have, the points of the call open after the slice and the calls begun in between. The maps of a
key's slices are composed in order, which gives each slice the call that is open before it, and every slice is packed alone. Calls
begun from different states soon begin at the same snapshots, so that a map costs little more than one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.operators.health import FS_POINTS, INSTANCE_POINTS, MOST_POINTS, packed
from gaugeflow.operators.slices import SLICE, Slices


def slice_map(n_fs: Sequence[int], most: int = MOST_POINTS) -> tuple[np.ndarray, np.ndarray]:
    """(points of the open call afterwards, calls begun) for each number of points 0 .. most of the call that is open before; n_fs: of snapshots in order."""
    with_instance, without = (most - INSTANCE_POINTS) // FS_POINTS, most // FS_POINTS
    state, begun = np.arange(most + 1), np.zeros(most + 1, np.int64)
    place = np.arange(most + 1)  # of each entry state, its distinct state by now
    for k, n in enumerate(n_fs):
        points = INSTANCE_POINTS + FS_POINTS * int(n)
        if points > most:
            begun = begun + (state > 0) + 1 + max(0, -(-(int(n) - with_instance) // without))
            state = np.zeros_like(state)
        else:
            over = state + points > most
            begun, state = begun + over, np.where(over, points, state + points)
        if len(state) > 1 and (k < 8 or k % 64 == 0):
            # States that have met stay together; what they began so far differs, so that only equal pairs are put together.
            pairs, back = np.unique(np.stack([state, begun]), axis=1, return_inverse=True)
            state, begun, place = pairs[0], pairs[1], back.ravel()[place]
    return state[place], begun[place]


def pack_batches(snapshots: DataFrame, keys: list[str], slices: Slices, most: int = MOST_POINTS) -> DataFrame:
    """health.pack_batches with the snapshots of hot keys cut along ts into slices (find_slices with these keys)."""
    rows = slices.of(snapshots.select(*keys, F.col("ts").cast("double").alias("ts"), F.col("n_fs").cast("long").alias("n_fs")))
    part = [*keys, SLICE]
    plain = rows.select(*keys, "ts").schema.fields
    out = T.StructType(plain).add("fs_from", "long").add("fs_count", "long").add("with_instance", "boolean").add("batch", "long")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return packed(pdf, keys, most, int(pdf["_used"].iloc[0]), int(pdf["_batch"].iloc[0]))

    if slices.cuts is None:
        return rows.withColumns({"_used": F.lit(0), "_batch": F.lit(0)}).groupBy(*part).applyInPandas(pack, out)
    key_fields = rows.select(*part).schema.fields

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        state, begun = slice_map(pdf.sort_values(["ts", "n_fs"], kind="stable")["n_fs"].tolist(), most)
        return pdf[part].iloc[:1].assign(state=[state], begun=[begun])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, used, batch, entered = pdf.sort_values(SLICE), 0, 0, []
        for state, begun in zip(pdf["state"], pdf["begun"]):
            entered.append((used, batch))
            used, batch = int(state[used]), batch + int(begun[used])
        return pdf[part].assign(**dict(zip(("_used", "_batch"), zip(*entered))))

    hot = rows.join(F.broadcast(slices.cuts.select(*keys)), keys, "left_semi")
    maps = hot.groupBy(*part).applyInPandas(summarise, T.StructType([*key_fields, T.StructField("state", T.ArrayType(T.LongType())), T.StructField("begun", T.ArrayType(T.LongType()))]))
    # A key has a bounded number of slices, and a map has most + 1 entries.
    entered = maps.groupBy(*keys).applyInPandas(compose, T.StructType([*key_fields, T.StructField("_used", T.LongType()), T.StructField("_batch", T.LongType())]))
    known = rows.join(entered, part, "left").fillna(0, ["_used", "_batch"])
    return known.groupBy(*part).applyInPandas(pack, out)
