"""Tiled scoring of large vocabularies against the scores held whole."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dotloom.functions.scalars import normalised
from dotloom.operators import scoring as V
from dotloom.operators.vocabulary import COLUMNS, ROWS, Tile, vocabulary_loss, vocabulary_scores


def _tables(spark, classes=60, rows=40, width=6, seed=3):
    rng = random.Random(seed)
    vec = lambda: [rng.choice([-1.0, -0.5, 0.1, 0.3, 1.0]) for _ in range(width)]
    some = [vec() for _ in range(classes // 3)]
    # Equal and scaled vectors under several ids: ties.
    mu = {i * 7 - 20: rng.choice(some) for i in range(classes)}
    means = spark.createDataFrame(list(mu.items()), "class_idx long, mu array<double>").withColumn("unit", normalised(F.col("mu")))
    linear = means.where("class_idx % 2 = 0").select("class_idx", F.col("mu").alias("w"), (F.col("class_idx") % 3 * 0.1).alias("b"))
    vectors = [(i, rng.choice(some) if i % 2 else vec(), rng.choice(list(mu))) for i in range(rows)]
    return spark.createDataFrame(vectors, "cand_id long, z array<double>, target long").repartition(3), means, linear


@pytest.mark.parametrize("kind", ["cosine", "linear", "margin", "hybrid"])
@pytest.mark.parametrize("most_bytes", [10**9, 900])
def test_equal_to_scores_held_whole(spark, kind, most_bytes):
    vectors, means, linear = _tables(spark)
    got = {r.cand_id: r for r in vocabulary_scores(vectors, means, linear, kind, "target", k=4, raw_alpha=0.3, most_bytes=most_bytes).collect()}
    whole = V.with_head(V.head_scores(vectors, means, linear, raw_alpha=0.3), kind)
    want = whole.select("cand_id", V.rank_of("logit", "target").alias("rank"), V.at_class("logit", "target").alias("own"), V.log_sum("logit").alias("lse")).collect()
    top = {}
    for r in V.top_classes(whole, "logit", 4).orderBy("cand_id", "rank").collect():
        top.setdefault(r.cand_id, []).append(r.class_idx)
    assert len(got) == len(want) == 40
    for w in want:
        g = got[w.cand_id]
        assert (g["rank"], g.target_score, [x.class_idx for x in g.top]) == (w["rank"], w.own, top[w.cand_id])
        assert g.log_sum == pytest.approx(w.lse, rel=1e-12)


@pytest.mark.parametrize("smoothing", [0.0, 0.2])
def test_loss_equals_the_plain_one(spark, smoothing):
    vectors, means, linear = _tables(spark, seed=5)
    weights = means.where("class_idx % 3 <> 0").select("class_idx", (F.abs("class_idx") % 5 + 0.5).alias("weight"))
    rows = vocabulary_scores(vectors, means, linear, "hybrid", "target", loss_temperature=0.5, weights=weights, most_bytes=1500)
    got = {r.cand_id: r.loss for r in vocabulary_loss(rows, "target", 0.5, smoothing, weights).collect()}
    by = F.create_map(*[F.lit(v) for r in weights.collect() for v in (r.class_idx, r.weight)])
    whole = V.head_scores(vectors, means, linear).withColumn("by", by)
    for r in whole.select("cand_id", V.cross_entropy("hybrid", "target", 0.5, smoothing, "by").alias("ce")).collect():
        assert got[r.cand_id] == pytest.approx(r.ce, rel=1e-10)


def test_rows_and_classes_without_scores(spark):
    bad = float("nan")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 5, "x"), (2, None, 5, "y"), (3, [1.0, None], 5, None), (4, [1.0], 5, "x"), (5, [bad, 1.0], 5, "x"), (6, [0.0, 0.0], None, "x"), (7, [0.0, 2.0], 99, "x")], "cand_id long, z array<double>, target long, class_idx string")
    means = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0]), (7, None), (8, [bad, 0.0]), (9, [1.0]), (None, [1.0, 0.0])], "class_idx long, unit array<double>")
    linear = spark.createDataFrame([(5, [bad, 1.0], 1.0), (6, None, 1.0)], "class_idx long, w array<double>, b double")
    got = {r.cand_id: r for r in vocabulary_scores(vectors, means, linear, "hybrid", "target", k=3).collect()}
    assert len(got) == 7 and got[1].class_idx == "x"
    assert got[1]["rank"] == 0 and [x.class_idx for x in got[1].top] == [5, 6] and got[1].n_classes == 2
    for i in (2, 3, 4, 5):
        assert (got[i]["rank"], got[i].log_sum, got[i].top) == (None, None, [])
    assert got[6]["rank"] is None and [x.class_idx for x in got[6].top] == [5, 6]
    assert got[7]["rank"] is None and got[7].top[0].class_idx == 6
    empty = vocabulary_scores(vectors, means.limit(0), None, "cosine", "target").collect()
    assert len(empty) == 7 and all(r.top == [] and r.log_sum is None for r in empty)
    assert vocabulary_scores(vectors.limit(0), means, linear).count() == 0
    with pytest.raises(ValueError):
        vocabulary_scores(vectors, means, linear, "other")


def test_many_classes_in_tiles_of_a_bounded_size(spark):
    n, width = 200_000, 4
    means = spark.range(n).select(F.col("id").alias("class_idx"), F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(width)]).alias("mu")).withColumn("unit", normalised(F.col("mu")))
    vectors = spark.range(3).select("id", F.array(*[F.cos(F.col("id") + k) for k in range(width)]).alias("z"), (F.col("id") * 1000).alias("target"))
    got = vocabulary_scores(vectors, means, None, "cosine", "target", most_bytes=4_000_000).orderBy("id").collect()
    unit = np.sin(np.arange(n)[:, None] * np.arange(1, width + 1))
    unit /= np.maximum(np.sqrt((unit * unit).sum(1)), 1e-12)[:, None]
    for r in got:
        z = np.array(r.z)
        x = unit @ z / np.sqrt(z @ z) / 0.07
        assert abs(r["rank"] - (x > x[r.target]).sum()) <= 1
        assert r.top[0].score == pytest.approx(x.max(), rel=1e-12) and r.n_classes == n


def test_equal_classes_take_bounded_memory():
    # All classes are equal: each pair of a candidate and a class is close to the own score and one of the best.
    width, k = 64, 5
    vec = [1.0 / 8] * width
    cols = {"class_idx": list(range(COLUMNS)), "unit": [vec] * COLUMNS, "w": [vec] * COLUMNS, "b": [0.0] * COLUMNS, "weight": [1.0] * COLUMNS}
    tile = Tile(pa.table(cols), "hybrid", 0.07, 0.5, 1.0, k)
    z, n = np.tile(np.array(vec), (ROWS, 1)), np.ones(ROWS)
    zero = np.zeros(ROWS, np.int64)
    own = tile.exact(z, n, np.arange(ROWS), zero)
    state = {"above": zero.copy(), "high": np.full(ROWS, -np.inf), "mass": np.zeros(ROWS), "weight": np.zeros(ROWS), "weighted": np.zeros(ROWS)}
    state |= {"ids": np.full((ROWS, k), 2**63 - 1), "best": np.full((ROWS, k), -np.inf)}
    tracemalloc.start()
    tile.add(z, n, own, state)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (state["above"] == 0).all() and (state["ids"] == np.arange(k)).all()
    assert most < 200e6
