"""Calls packed over slices are those of the plain rule."""

import random

import pandas as pd
import pytest

from gaugeflow.operators import batches as B
from gaugeflow.operators import health as H
from gaugeflow.operators import slices as C


def brute(n_fs, used, most):
    """(points of the open call, calls begun) by the plain rule."""
    batch = 0
    for n in n_fs:
        points = 12 + 9 * n
        if points > most:
            batch += used > 0
            batch += 1 + max(0, -(-(n - (most - 12) // 9) // (most // 9)))
            used = 0
        elif used + points > most:
            batch, used = batch + 1, points
        else:
            used += points
    return used, batch


@pytest.mark.parametrize("most", [60, 1000])
def test_slice_maps(most):
    rng = random.Random(2)
    for _ in range(12):
        n_fs = [rng.choice([0, 1, 3, 7, 200, rng.randrange(60)]) for _ in range(rng.randrange(0, 150))]
        state, begun = B.slice_map(n_fs, most)
        for used in range(0, most + 1, 7):
            assert (state[used], begun[used]) == brute(n_fs, used, most)
        pdf = pd.DataFrame({"k": 0, "ts": range(len(n_fs)), "n_fs": n_fs})
        if n_fs:
            last = H.packed(pdf, ["k"], most)["batch"].iloc[-1]
            assert last == begun[0] - (state[0] == 0)  # after a split snapshot no call is open


@pytest.mark.parametrize("parts", [2, 40])
def test_packing_over_slices(spark, parts):
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(900)), rng.choice([0, 2, 5, 30, 300])) for _ in range(2000)] + [(f"h{i % 40}", float(i), i % 50) for i in range(900)]
    snaps = spark.createDataFrame(rows, "host string, ts double, n_fs int")
    slices = C.find_slices(snaps, "ts", parts, 100, ["host"])
    assert slices.cuts.count() == 1
    got, plain = B.pack_batches(snaps, ["host"], slices), H.pack_batches(snaps, ["host"])
    assert got.columns == plain.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    none = C.find_slices(snaps, "ts", parts, 10**9, ["host"])
    assert sorted(map(tuple, B.pack_batches(snaps, ["host"], none).collect())) == sorted(map(tuple, plain.collect()))
