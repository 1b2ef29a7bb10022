"""Running sums over ranges, and exact ranking, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from dotloom.operators import detection as E
from dotloom.operators import relations as R
from dotloom.operators.prefix import running_sums


@pytest.mark.parametrize("keys", [0, 1, 3, 40])
def test_running_sums_equal_plain_ones(spark, keys):
    rng = random.Random(keys)
    # One key has most of the rows.
    rows = {(0 if rng.random() < 0.7 else rng.randrange(keys or 1), rng.randrange(400) / 7): (rng.randrange(5), rng.random()) for _ in range(900)}
    d = spark.createDataFrame([(k if k != 2 else None, s, *v) for (k, s), v in rows.items()], "k int, s double, p long, q double").repartition(5)
    got = {(r.k, r.s): (r.p_to, r.q_to) for r in running_sums(d, ["k"] if keys else [], -F.col("s"), "p", "q").collect()}
    assert len(got) == len(rows)
    for (k, s), _ in rows.items():
        upto = [v for (j, x), v in rows.items() if (not keys or j == k) and x >= s]
        p, q = got[k if k != 2 else None, s]
        assert p == sum(v[0] for v in upto) and q == pytest.approx(sum(v[1] for v in upto))


def test_running_sums_without_rows_and_without_one_window_for_all(spark):
    d = spark.createDataFrame([], "s double, p long")
    assert running_sums(d, [], F.col("s"), "p").count() == 0
    plan = running_sums(spark.createDataFrame([(1.0, 2)], "s double, p long"), [], F.col("s"), "p")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def _auc(rows):
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_ranking_keeps_scores_apart_that_differ_in_the_last_place(spark):
    rng = random.Random(4)
    near = [1.0, 1.0 - 2**-53, 1.0 - 2**-52, 0.1 + 0.2, 0.3]
    rows = [(rng.choice(near) if rng.random() < 0.5 else rng.random(), rng.random() < 0.4) for _ in range(500)]
    d = spark.createDataFrame([*rows, (None, True), (0.5, None)], "s double, t boolean").repartition(4)
    r = R.ranking(d, "s", "t").first()
    order = sorted({s for s, _ in rows}, reverse=True)
    n_pos = sum(t for _, t in rows)
    ap = sum(sum(t for x, t in rows if x == s) * sum(t for x, t in rows if x >= s) / sum(x >= s for x, _ in rows) for s in order) / n_pos
    assert r.positives == n_pos and r.auc == pytest.approx(_auc(rows), abs=1e-9) and r.ap == pytest.approx(ap, abs=1e-9)
    none = R.ranking(d.where("t"), "s", "t").first()
    assert none.auc is None and none.ap == 1.0 and R.ranking(d.limit(0), "s", "t").first().positives == 0


def test_average_precision_of_a_hot_class(spark):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.9 else rng.randrange(2, 5), rng.randrange(60) / 61, i if rng.random() < 0.5 else None) for i in range(700)]
    truths = [(c, i) for c in (1, 2, 3, 9) for i in range(300)]
    d = spark.createDataFrame(rows, "class_idx long, score double, gt_id long").repartition(6)
    got = {r.class_idx: (r.ap, r.recall) for r in E.precision_recall(d, spark.createDataFrame(truths, "class_idx long, gt_id long")).collect()}
    for c in (1, 2, 3, 9):
        own = [(s, g is not None) for k, s, g in rows if k == c]
        area = sum(sum(h for x, h in own if x == s) * sum(h for x, h in own if x >= s) / sum(x >= s for x, _ in own) for s in {s for s, _ in own})
        assert got[c] == (pytest.approx(area / 300, abs=1e-9), pytest.approx(sum(h for _, h in own) / 300, abs=1e-9))


def test_direction_accuracy(spark):
    d = spark.createDataFrame([(1, 2, 0.9, 0.5), (2, 1, 0.1, 0.0), (3, 4, 0.2, 0.0), (4, 3, 0.2, 0.7), (5, 6, 0.3, 0.1), (6, 5, 0.9, 0.1), (7, 8, 0.4, 0.3), (10, 9, 0.2, 0.3), (9, 10, 0.6, 0.1)], "i long, j long, a_part double, y_part double")
    assert tuple(R.direction_accuracy(d).first()) == (3, 0.5)
