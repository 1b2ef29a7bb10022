"""Dot recall kept up to date while candidates and dots arrive: keyed state, bounded by the image."""

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from dotloom.operators import masks as M
from dotloom.sources.cache import _read

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of pixels that one state holds, so that a very large or busy image is spread over tasks.
BAND = 16
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(ends[order])
    head = np.ones(len(starts), bool)
    head[1:] = starts[1:] > far[:-1]
    return starts[head], far[np.append(head[1:], True)[: len(far)]]


def _held(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return at < np.append(ends, np.iinfo(np.int64).min)[np.searchsorted(starts, at, "right") - 1]


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs of the union, in their order; runs that touch become one, empty ones go."""
    some = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2)
    return list(zip(*(v.tolist() for v in _merged(some[:, 0], some[:, 1])), strict=True))


def uncovered(xs: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """The positions that none of the disjoint runs holds."""
    starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
    at = np.array(xs, np.int64)
    return at[~_held(at, starts, ends)].tolist()


def settled(cells: np.ndarray) -> tuple[np.ndarray, int]:
    """The cells of a band with disjoint runs and each place's open dots once, and the number of dots that were covered.

    ``cells`` has the rows y, xs, xe and times: a run with times 0, or so many dots at xs. Places are ranked, so that all
    rows of pixels lie behind each other on one line whatever their numbers are.
    """
    y, xs, xe, times = cells
    low, places = y.min(initial=0), np.unique(np.concatenate([xs, xe]))
    base, dot = (y - low) * len(places), times > 0
    s, e = base + np.searchsorted(places, xs), base + np.searchsorted(places, xe)
    starts, ends = _merged(s[~dot], e[~dot])
    left = ~_held(s[dot], starts, ends)
    at, group = np.unique(s[dot][left], return_inverse=True)
    number = np.zeros(len(at), np.int64)
    np.add.at(number, group, times[dot][left])
    starts, ends, number = np.concatenate([starts, at]), np.concatenate([ends, at]), np.concatenate([np.zeros(len(starts), np.int64), number])
    n = max(len(places), 1)
    return np.array([starts // n + low, places[starts % n], places[ends % n], number]), int(times.sum() - number.sum())


def _cells(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(4, -1)


#: What ``combined`` makes of dots and runs: a band's dots, those of them that are covered, and ``settled`` cells.
BANDS = "image long, known boolean, band long, dots long, cov long, cells binary"


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (image, known, band, kind, y, xs, xe) of a batch as one row for each band."""
    for b in batches:
        if not b.num_rows:
            continue
        image, band, y, xs, xe = (b.column(c).to_numpy() for c in ("image", "band", "y", "xs", "xe"))
        known, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("known", "kind"))
        run, lost = kind == "run", kind == "lost"
        cells = np.array([y, xs, np.where(run, xe, xs), ~run], np.int64)
        order = np.lexsort((band, image, known))
        keys = np.array([image, known, band], np.int64)[:, order]
        first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
        dots, cov, packed = [], [], []
        for rows in np.split(order, first[1:]):
            some, covered = settled(cells[:, rows[~lost[rows]]])
            dots.append(int((~run[rows]).sum()))
            cov.append(covered)
            packed.append(some.tobytes())
        image, known, band = keys[:, first]
        yield pa.RecordBatch.from_arrays([pa.array(image), pa.array(known > 0), pa.array(band), pa.array(dots, pa.int64()), pa.array(cov, pa.int64()), pa.array(packed, pa.binary())], names=["image", "known", "band", "dots", "cov", "cells"])


class Cover(StatefulProcessor):
    """The state of a band of an image: the disjoint runs of all masks so far and the dots that none holds, and both counts.

    A batch reads and writes the state of a band once, however many rows of pixels it touches. Runs grow to at most half
    the width a row, however many candidates come; dots at one place are one entry and leave the state once covered.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("band", "dots long, cov long, cells binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        image, known, band = key
        old = self.state.get()
        dots, cov, packed = (0, 0, b"") if old is None else old
        before, parts = (dots, cov), [_cells(packed)]
        for r in rows:
            dots, cov = dots + r.dots, cov + r.cov
            parts.append(_cells(r.cells))
        cells, covered = settled(np.concatenate(parts, axis=1))
        cov += covered
        self.state.update((dots, cov, cells.tobytes()))
        if (dots, cov) != before:
            yield Row(image_id=image if known else None, band=band, dots=dots, cov=cov)

    def close(self) -> None:
        pass


def recall_updates(dots: DataFrame, runs: DataFrame, radius: int = 0) -> DataFrame:
    """(image_id, band, dots, cov) of each band of an image whose counts a batch changed; bands add up to what ``operators.dots.recall_rows`` counts.

    ``dots`` (image_id, xi, yi) and ``runs`` (image_id, y, xs, xe) are streams; either may come first, in any order and
    number of batches. Each row counts once, so sources must deliver each once, as files do. Bands without dots give no
    row; dots without a place or an image are counted and never covered.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    placed = F.col("image_id").isNotNull() & F.col("yi").isNotNull() & F.col("xi").isNotNull()
    d = dots.select("image_id", F.when(placed, "dot").otherwise("lost").alias("kind"), zero("yi").alias("y"), zero("xi").alias("xs"), F.lit(0).cast("long").alias("xe"))
    r = M.dilated(runs, radius).where("image_id IS NOT NULL AND xs < xe AND y IS NOT NULL").select("image_id", F.lit("run").alias("kind"), zero("y").alias("y"), zero("xs").alias("xs"), zero("xe").alias("xe"))
    # Nulls would make Arrow columns floating and keys that find no state: none is left.
    known = F.col("image_id").isNotNull()
    rows = d.union(r).select(zero("image_id").alias("image"), known.alias("known"), F.floor(F.col("y") / BAND).alias("band"), "kind", "y", "xs", "xe")
    bands = rows.mapInArrow(combined, BANDS)
    return bands.groupBy("image", "known", "band").transformWithState(Cover(), "image_id long, band long, dots long, cov long", "Update", "None")


def follow_recall(dots: DataFrame, runs: DataFrame, target: str, checkpoint: str, radius: int = 0) -> StreamingQuery:
    """Writes the updates of ``recall_updates`` below ``target``, a folder a batch; ends when what is there has been read.

    Started again with the same ``checkpoint`` it goes on with the states it had; a batch that runs twice replaces its
    own folder. States need the RocksDB store, which is set for this query alone.
    """
    spark = dots.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        out = recall_updates(dots, runs, radius).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return out.foreachBatch(lambda d, n: d.write.mode("overwrite").parquet(f"{target}/batch={n}")).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def latest_recall(spark: SparkSession, target: str) -> DataFrame:
    """(image_id, dots, cov): the last update of each band, added up by image; empty before the first batch."""
    d = _read(spark, target)
    if d is None:
        return spark.createDataFrame([], "image_id long, dots long, cov long")
    last = d.groupBy("image_id", "band").agg(F.max_by(F.struct("dots", "cov"), "batch").alias("l"))
    return last.groupBy("image_id").agg(F.sum("l.dots").alias("dots"), F.sum("l.cov").alias("cov"))
