"""Greedy cover on bits and near boxes by space, against plain versions."""

import random
import time

import numpy as np
import pytest

from dotloom.operators import dots as D
from dotloom.operators import masks as M


def _plain(pairs):
    sets = {}
    for c, d in pairs:
        sets.setdefault(c, set()).add(d)
    left, picks = {d for _, d in pairs}, 0
    while left:
        best = max(sorted(sets), key=lambda c: len(sets[c] & left))
        left -= sets[best]
        picks += 1
    return picks


def test_cover_equals_the_plain_greedy_one():
    rng = random.Random(3)
    for _ in range(300):
        n, m = rng.randrange(1, 14), rng.choice([3, 40, 64, 65, 150])
        pairs = [(rng.randrange(n) * 7, rng.randrange(m)) for _ in range(rng.randrange(1, 4 * m))]
        assert D.greedy_cover(*map(np.array, zip(*pairs, strict=True))) == _plain(pairs)


def test_an_image_of_five_thousand_candidates_and_dots_takes_seconds():
    rng = np.random.default_rng(1)
    cand, dot = np.repeat(np.arange(5000), 40), rng.integers(0, 5000, 200_000)
    start = time.time()
    picks = D.greedy_cover(cand, dot)
    assert time.time() - start < 20 and 120 < picks < 1000


def test_oracle_of_images(spark):
    dots = spark.createDataFrame([(1, i, i, 0) for i in range(6)] + [(2, 9, 50, 50)], "image_id long, dot_id long, xi long, yi long")
    runs = spark.createDataFrame([(1, 5, 0, 0, 3), (1, 6, 0, 2, 5), (1, 7, 0, 1, 4)], "image_id long, cand_id long, y long, xs long, xe long")
    assert sorted(map(tuple, D.count_oracle(dots, runs).collect())) == [(1, 6, 5, 2), (2, 1, 0, 0)]


@pytest.mark.parametrize("box", [0.5, 0.2, 0.9])
def test_near_boxes_equal_all_pairs(spark, box):
    rng = random.Random(int(box * 10))
    boxes = []
    for i in range(400):
        w, h = (max(1, int(2 ** rng.uniform(0, 7))) for _ in range(2))
        boxes.append((i % 2, i, rng.choice([0, 7, 8, 31, 32, -5, 64]) + rng.randrange(9), rng.choice([0, 16, 63, 64]) + rng.randrange(5), w, h))
    boxes += [(0, 1000 + i, 200 + i % 2, 50, 60, 70 + i % 3) for i in range(9)]
    boxes += [(0, 900, 8, 16, 8, 8), (0, 901, 8, 16, 8, 8), (0, 902, 12, 16, 8, 8), (0, 903, 8, 16, 16, 8), (0, 904, 0, 0, 0, 5)]

    def iou(a, b):
        ix, iy = (max(0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (2, 3))
        return ix * iy / (a[4] * a[5] + b[4] * b[5] - ix * iy)

    want = {(a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and a[4] * b[4] and iou(a, b) > box}
    got = list(map(tuple, M.near_boxes(spark.createDataFrame(boxes, "image_id long, cand_id long, x1 long, y1 long, w long, h long"), box).collect()))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def _runs(rng, n, width):
    return [(1, rng.randrange(n), y, xs, xs + w) for y in range(3) for xs, w in ((rng.randrange(-20, width), rng.choice([1, 5, 63, 64, 65, 200])) for _ in range(120))]


def test_intersections_over_tiles_equal_plain_ones(spark):
    rng = random.Random(6)
    a, b = _runs(rng, 5, 400), _runs(rng, 4, 400)
    schema = "image_id long, {} long, y long, xs long, xe long"
    got = {(r.cand_id, r.gt_id): r.inter for r in M.intersections(spark.createDataFrame(a, schema.format("cand_id")), spark.createDataFrame(b, schema.format("gt_id"))).collect()}
    want = {}
    for _, i, y, s, e in a:
        for _, j, z, t, f in b:
            if y == z and min(e, f) > max(s, t):
                want[i, j] = want.get((i, j), 0) + min(e, f) - max(s, t)
    assert got == want
    dots = [(1, k, rng.randrange(-30, 500), rng.randrange(3)) for k in range(300)]
    d, r = spark.createDataFrame(dots, "image_id long, dot_id long, xi long, yi long"), spark.createDataFrame(a, schema.format("cand_id"))
    for radius in (0, 3):
        hit = {(k, c) for _, k, x, y in dots for _, c, z, s, e in a if abs(y - z) <= radius and s - radius <= x < e + radius}
        assert {(h.dot_id, h.cand_id) for h in D.hits(d, r, radius).collect()} == hit
        row = D.recall_rows(d, r, radius).first()
        assert (row.dots, row["cov"]) == (300, len({k for k, _ in hit}))


def test_ten_thousand_runs_of_a_row_do_not_square(spark):
    a = spark.range(10_000).selectExpr("1L AS image_id", "id % 2 AS cand_id", "0L AS y", "id * 10 AS xs", "id * 10 + 4 AS xe")
    b = a.withColumnRenamed("cand_id", "gt_id")
    met = M.tiled(a).join(M.tiled(b.withColumnsRenamed({"xs": "xs2", "xe": "xe2"}), "xs2", "xe2"), ["image_id", "y", "tile"]).count()
    assert met < 40 * 10_000
    assert {(r.cand_id, r.gt_id): r.inter for r in M.intersections(a, b).collect()} == {(0, 0): 20_000, (1, 1): 20_000}
