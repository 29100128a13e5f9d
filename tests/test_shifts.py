"""Shifted duplicates: many groups go through Python at once."""

import random
from collections import defaultdict

import pyarrow as pa

from gaugeflow.operators import export as X


def plain(rows):
    """The rule, one group at a time, by seq."""
    groups, out = defaultdict(set), []
    for batch, path, seq, ts in sorted(rows, key=lambda r: r[2]):
        ms = None if ts is None else int(ts * 1000)
        if None not in (batch, path, ms):
            while ms in groups[batch, path]:
                ms += 1
            groups[batch, path].add(ms)
        out.append((batch, path, seq, ms))
    return sorted(map(repr, out))


def random_rows(n):
    rng = random.Random(n)
    return [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", "/a", "/b"]), seq, rng.choice([None, 0.0, 1.0, 2.0, 3.0, 4.0])) for seq in rng.sample(range(n), n)]


def test_groups_are_the_plain_rule(spark):
    rows = random_rows(600)
    out = X.shift_duplicates(spark.createDataFrame(rows, "batch int, path string, seq long, ts double").repartition(3))
    assert sorted(repr((r.batch, r.path, r.seq, r.ms)) for r in out.collect()) == plain(rows)


def test_groups_go_on_over_batches():
    """One call takes the rows of many groups, and a group may go on in the next one."""
    rows = sorted((r for r in random_rows(300) if r[0] and r[1]), key=lambda r: r[:3])
    whole = pa.RecordBatch.from_pydict({"batch": [r[0] for r in rows], "path": [r[1] for r in rows], "seq": [r[2] for r in rows], "ms": pa.array([None if r[3] is None else int(r[3] * 1000) for r in rows], pa.int64())})
    for size in (1, 7, len(rows)):
        out = list(X._shifted(iter([whole[i : i + size] for i in range(0, len(rows), size)])))
        assert len(out) == -(-len(rows) // size)
        assert sorted(repr((b, p, s, m)) for x in out for b, p, s, m in zip(*(x.column(i).to_pylist() for i in range(4)))) == plain(rows)
