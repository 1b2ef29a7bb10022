"""Sums of long vectors over the rows of a table, added up on the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks that read a table at most, so that their number and what they send don't grow with the input; entries of a block.
TASKS, BLOCK = 4096, 1 << 16


def summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of the vectors that ``partial`` makes of each task's batches; none where all give none.

    A vector is sent in blocks, a block of all tasks is added up in one place, and the driver gets one vector.
    """

    def send(batches):
        vector = partial(batches)
        if vector is not None:
            cut = np.append(np.arange(0, len(vector), BLOCK), len(vector)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut) - 1, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(cut), pa.array(vector, pa.float64()))], ["k", "v"])

    def add(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, k in enumerate(batch.column("k").to_pylist()):
                v = batch.column("v")[i].values.to_numpy()
                have[k] = have[k] + v if k in have else v
        for k, v in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))], ["k", "v"])

    parts = rows.coalesce(TASKS).mapInArrow(send, "k int, v array<double>")
    got = parts.repartition(min(64, rows.sparkSession.sparkContext.defaultParallelism * 2), "k").mapInArrow(add, "k int, v array<double>").toArrow()
    if not got.num_rows:
        return None
    blocks = dict(zip(got.column("k").to_pylist(), got.column("v"), strict=True))
    return np.concatenate([blocks[k].values.to_numpy() for k in sorted(blocks)])
