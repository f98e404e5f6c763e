"""Whole arrays as the unit of aggregation: sums in Arrow batches, a row a task and key between stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Keys whose sums a task holds at a time; beyond them it hands on what it has and begins anew.
HELD_KEYS = 4096


class _Sums:
    """By key, element-wise sums and counts of arrays that may differ in length."""

    def __init__(self) -> None:
        self.place: dict[tuple, int] = {}
        self.sums: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: list[tuple], at: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Row i of the flat sums and counts, from at[i] to at[i + 1], goes to keys[i]."""
        for i, key in enumerate(keys):
            s, c = sums[at[i] : at[i + 1]], counts[at[i] : at[i + 1]]
            k = self.place.setdefault(key, len(self.sums))
            if k == len(self.sums):
                self.sums.append(s.copy())
                self.counts.append(c.copy())
            elif len(s) <= len(self.sums[k]):
                self.sums[k][: len(s)] += s
                self.counts[k][: len(c)] += c
            else:
                s, c = s.copy(), c.copy()
                s[: len(self.sums[k])] += self.sums[k]
                c[: len(self.counts[k])] += self.counts[k]
                self.sums[k], self.counts[k] = s, c

    def add_batch(self, keys: pa.RecordBatch, column: pa.Array) -> None:
        """Rows of one key and length are summed as a matrix before they are added to what is held."""
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        v = column.flatten()
        there = v.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        v = v.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes)])
        frame = keys.to_pandas()
        group = frame.groupby(list(frame), sort=False, dropna=False).ngroup().to_numpy()
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            mine = mine[np.argsort(group[mine], kind="stable")]
            first = np.flatnonzero(np.diff(group[mine], prepend=-1))
            place = at[mine][:, None] + np.arange(size)
            sums, counts = (np.add.reduceat(x[place], first, axis=0).ravel() for x in (v, there)) if size else (v[:0], there[:0])
            names = list(zip(*(c.to_pylist() for c in keys.take(pa.array(mine[first])).columns)))
            self.add(names, np.arange(len(first) + 1) * size, sums, counts)

    def batch(self, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        keys = list(zip(*self.place)) or [()] * len(names)
        at = pa.array(np.cumsum([0, *map(len, self.sums)]), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else np.zeros(0), t)) for x, t in ((self.sums, pa.float64()), (self.counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, kinds)), *lists], [*names, "s", "c"])


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and entries of a list column; a null list is an empty one."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()


def mean_arrays(rows: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """(by, out): element-wise means of the arrays of each key; null entries don't count, NaN ones make NaN.

    Every task sums its own rows first, so a key that holds a third of all rows sends one row a task (and for every
    `HELD_KEYS` keys beyond), never one a row or an entry. Keys without any entry are left out.
    """
    fields = [rows.schema[n] for n in by]
    names = [f"k{i}" for i in range(len(by))]
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields))
    slim = rows.select(*(F.col(b).alias(n) for b, n in zip(by, names)), F.col(column).cast("array<double>").alias("v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = _Sums(), None
        for b in batches:
            kinds = [b.column(n).type for n in names]
            held.add_batch(b.select(names), b.column("v"))
            if len(held.place) >= HELD_KEYS:
                yield held.batch(names, kinds)
                held = _Sums()
        if held.place:
            yield held.batch(names, kinds)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = _Sums(), None
        for b in batches:
            kinds = [b.column(n).type for n in names]
            (at, s), (_, c) = _flat(b.column("s")), _flat(b.column("c"))
            held.add(list(zip(*(b.column(n).to_pylist() for n in names))), at, s.to_numpy(zero_copy_only=False), c.to_numpy(zero_copy_only=False))
        if held.place:
            yield held.batch(names, kinds)

    sums = f"{ddl}, s array<double>, c array<long>"
    done = slim.mapInArrow(partial, sums).groupBy(*names).applyInArrow(total, sums)
    mean = F.zip_with("s", "c", lambda s, c: F.when(c > 0, s / c))
    return done.filter(F.size("s") > 0).select(*(F.col(n).alias(b) for n, b in zip(names, by)), mean.alias(out))
