"""Recall by keyed state against recall of whole tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from dotloom.operators import dots as D
from dotloom.streaming.recall import BAND, Cover, combined, follow_recall, latest_recall, merged_spans, settled, uncovered

DOTS, RUNS = "image_id long, dot_id long, xi long, yi long", "image_id long, cand_id long, y long, xs long, xe long"


def test_spans_and_dots():
    rng = random.Random(1)
    for _ in range(200):
        spans = [(a, a + rng.randrange(-1, 6)) for a in (rng.randrange(30) for _ in range(rng.randrange(6)))]
        got, held = merged_spans(spans), {x for a, b in spans for x in range(a, b)}
        assert {x for a, b in got for x in range(a, b)} == held
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))
        xs = [rng.randrange(-2, 40) for _ in range(20)]
        assert uncovered(xs, got) == [x for x in xs if x not in held]


def _follow(spark, tmp, n, dots, runs, radius=0):
    """Adds rows to the sources, if any, and runs the query to their end."""
    for name, rows, schema in (("dots", dots, DOTS), ("runs", runs, RUNS)):
        if rows or n == 0:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp}/{name}")
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp}/{name}")
    follow_recall(read("dots", DOTS), read("runs", RUNS), f"{tmp}/out", f"{tmp}/checkpoint", radius).awaitTermination()


@pytest.mark.parametrize("radius", [0, 1])
def test_any_order_and_restarts_equal_whole_tables(spark, tmp_path, radius):
    rng = random.Random(radius)
    image = lambda: rng.choice([1, 1, 1, 2, 3, 4])
    dots = [(image(), i, rng.randrange(30), rng.randrange(40)) for i in range(60)] + [(None, 90, 1, 1), (2, 91, None, 1), (2, 92, 3, None), (9, 93, 3, 3), (1, 7, 2, 2), (1, 7, 2, 2)]
    runs = [(image(), i, rng.randrange(40), a, a + rng.randrange(9)) for i in range(120) for a in [rng.randrange(24)]] + [(None, 80, 1, 0, 9), (2, 81, 1, None, 9), (7, 82, 1, 0, 9)]
    rng.shuffle(dots)
    rng.shuffle(runs)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    # Runs first, then dots of old and new rows, then both; the last start finds nothing.
    for n, (d, r) in enumerate([([], runs[:15]), (dots[:40], []), (dots[40:], runs[15:]), ([], [])]):
        _follow(spark, tmp_path, n, d, r, radius)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want = D.recall_rows(spark.createDataFrame(dots, DOTS), spark.createDataFrame(runs, RUNS), radius)
    key = lambda r: str(tuple(r))
    got = latest_recall(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.select(*got.columns).collect()), key=key)
    # A batch that is written again replaces its own updates.
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("batch", "image_id", "band").count().where(F.col("count") > 1).isEmpty()


def test_before_the_first_batch_there_is_no_recall(spark, tmp_path):
    assert latest_recall(spark, f"{tmp_path}/none").count() == 0


class _Calls:
    """States that count what is asked of them."""

    def __init__(self):
        self.calls, self.value = 0, None

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def _bands(rows):
    """Rows (kind, y, xs, xe) of one band as the state gets them."""
    names = ["image", "known", "band", "kind", "y", "xs", "xe"]
    cols = list(zip(*[(1, True, 0, *r) for r in rows], strict=True))
    out = next(combined(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)])))
    return [Row(**r) for r in out.to_pylist()]


def test_a_batch_meets_the_state_of_a_band_once(spark):
    state, cover = _Calls(), Cover()
    cover.init(state)
    dots = [("dot", y, x, 0) for y in range(BAND) for x in range(50)]
    (got,) = cover.handleInputRows((1, True, 0), iter(_bands(dots)), None)
    assert (got.dots, got.cov) == (50 * BAND, 0) and state.calls == 2
    # Dots at one place are one entry of the state, however many come.
    size = len(state.value[2])
    (got,) = cover.handleInputRows((1, True, 0), iter(_bands(dots * 20)), None)
    assert got.dots == 21 * 50 * BAND and state.calls == 4 and len(state.value[2]) == size
    (got,) = cover.handleInputRows((1, True, 0), iter(_bands([("run", y, 0, 40) for y in range(BAND)] + [("lost", 0, 0, 0)])), None)
    assert (got.dots, got.cov) == (21 * 50 * BAND + 1, 21 * 40 * BAND) and state.calls == 6


@pytest.mark.parametrize("far", [0, 2**62])
def test_settled_cells_equal_rows_of_their_own(far):
    rng = random.Random(2)
    for _ in range(60):
        runs = [(rng.randrange(-3, 4), a, a + rng.randrange(1, 6)) for a in (rng.randrange(30) for _ in range(rng.randrange(12)))] + [(1, -far, 2)]
        dots = [(rng.randrange(-3, 4), rng.randrange(40), rng.randrange(1, 4)) for _ in range(rng.randrange(40))]
        cells = np.array([(y, s, e, 0) for y, s, e in runs] + [(y, x, x, n) for y, x, n in dots], np.int64).T
        got, covered = settled(cells)
        want, left = set(), {}
        for row in {y for y, *_ in [*runs, *dots]}:
            spans = merged_spans([(s, e) for y, s, e in runs if y == row])
            want |= {(row, s, e) for s, e in spans}
            for x in uncovered([x for y, x, n in dots for _ in range(n) if y == row], spans):
                left[row, x] = left.get((row, x), 0) + 1
        rows = [tuple(map(int, c)) for c in got.T]
        assert {r[:3] for r in rows if r[3] == 0} == want and {(y, x): n for y, x, _, n in rows if n} == left
        assert len(rows) == len(want) + len(left) and covered == sum(n for *_, n in dots) - sum(left.values())
    assert settled(np.zeros((4, 0), np.int64))[0].shape == (4, 0)
