"""Typed keyed state of many keys at a time.

Each call from Python to the state store takes a fraction of a millisecond and each pandas operation about as long, however few rows there
are. So keys are dealt by hash into parts, each of which is one state key, and a part's keys into chunks: an entry of a map of
arrays. A micro-batch's rows of a part are worked on as arrays, and only the chunks that they touch are read and written.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of all keys, and chunks of each. A task holds a micro-batch's rows of one part.
PARTS, CHUNKS = 512, 32


def dealt(rows: DataFrame, keys: Sequence[str], parts: int = PARTS) -> DataFrame:
    """Adds the part and chunk of each row's key. (Their names must not begin with an underscore: Spark renames such columns on their way to a processor.)"""
    h = F.xxhash64(*keys)
    return rows.withColumns({"part": F.pmod(h, F.lit(parts)).cast("int"), "chunk": F.pmod(F.shiftright(h, 32), F.lit(CHUNKS)).cast("int")})


class Chunks:
    """A table in state. schema: "name type, ..." of its rows; on the outside they have the column chunk too."""

    def __init__(self, handle, name: str, schema: str):
        fields = [f.split() for f in schema.split(", ")]
        self.names = [name for name, _ in fields]
        self.kinds = {name: {"string": object, "boolean": bool, "double": float, "bigint": np.int64}.get(kind) for name, kind in fields}
        self.state = handle.getMapState(name, "chunk int", ", ".join(f"{name} array<{kind}>" for name, kind in fields))

    def _table(self, found: Iterable[tuple[int, Sequence[list]]]) -> pd.DataFrame:
        lists, chunk = [[] for _ in self.names], []
        for c, value in found:
            for whole, part in zip(lists, value):
                whole += part
            chunk += [c] * len(value[0])
        return pd.DataFrame({name: pd.Series(x, dtype=self.kinds[name] if x else self.kinds[name] or float) for name, x in zip(self.names, lists)}).assign(chunk=np.array(chunk, int))

    def read(self, chunks: Iterable[int]) -> pd.DataFrame:
        found = ((int(c), self.state.getValue((int(c),))) for c in chunks)
        return self._table((c, v) for c, v in found if v is not None)

    def read_all(self) -> pd.DataFrame:
        return self._table(sorted((int(k[0]), tuple(v)) for k, v in self.state.iterator()) if self.state.exists() else [])

    def write(self, table: pd.DataFrame, chunks: np.ndarray) -> None:
        """Replaces these chunks (in order) by their rows of the table, which are in the order of chunk."""
        own = table["chunk"].to_numpy()
        begin, end = np.searchsorted(own, chunks, "left"), np.searchsorted(own, chunks, "right")
        lists = []
        for name in self.names:
            x = table[name]
            # NaN stays in doubles, which have no null here.
            lists.append((x if self.kinds[name] is float else x.astype(object).where(x.notna(), None)).tolist())
        for c, a, b in zip(chunks.tolist(), begin.tolist(), end.tolist()):
            self.state.updateValue((c,), tuple(x[a:b] for x in lists))
