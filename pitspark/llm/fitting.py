"""Fits whose training rows stay where they are: a step of a fit is a sum over all slices of texts.

A slice is a row whose cells are bytes (arrays of numbers). The slices stand in a written table, or, for the texts
of a list, in memory. Sums are taken in whole numbers, so they depend neither on the order of the slices nor on
the partitions they are read in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import written

#: Parts of one that a sum is taken in.
UNIT = 2.0**40
#: Numbers of a sum that are added up in one place.
BLOCK = 1 << 15


class Slices:
    def __init__(self, rows: DataFrame | list[tuple]):
        self.rows = rows

    def total(self, make: Callable, state, size: int, unit: float = UNIT) -> np.ndarray:
        """The sum over all slices of the ``size`` numbers that ``make(state)(*cells)`` gives for one."""
        def whole(numbers: np.ndarray) -> np.ndarray:
            return np.rint(numbers * unit).astype(np.int64)

        if isinstance(self.rows, list):
            one = make(state)
            return sum((whole(one(*row)) for row in self.rows), np.zeros(size, np.int64)) / unit
        shared = self.rows.sparkSession.sparkContext.broadcast(state)

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, sums = make(shared.value), np.zeros(size, np.int64)
            for batch in batches:
                for cells in zip(*batch.columns):
                    sums += whole(one(*[c.as_py() for c in cells]))
            for i in range(0, size, BLOCK):
                if sums[i: i + BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sums[i: i + BLOCK].tobytes()], pa.binary())], names=["first", "sums"])

        def of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = np.frombuffer(part.as_py(), np.int64)
                    sums[i] = sums[i] + part if i in sums else part
            for i, part in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["first", "sums"])

        schema = "first int, sums binary"
        out = np.zeros(size, np.int64)
        for row in self.rows.mapInArrow(of_task, schema).repartition("first").mapInArrow(of_block, schema).collect():
            part = np.frombuffer(row["sums"], np.int64)
            out[row["first"]: row["first"] + len(part)] = part
        shared.destroy()
        return out / unit

    def map(self, make: Callable, state, names: list[str]) -> Slices:
        """New slices with the cells ``names`` that ``make(state)(*cells)`` gives, written."""
        if isinstance(self.rows, list):
            one = make(state)
            return Slices([one(*row) for row in self.rows])
        shared = self.rows.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one = make(shared.value)
            for batch in batches:
                for cells in zip(*batch.columns):
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in one(*[c.as_py() for c in cells])], names=names)

        found = Slices(written(self.rows.mapInArrow(run, ", ".join(f"{n} binary" for n in names))))
        shared.destroy()
        return found
