import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dotloom.functions import scalars as N
from dotloom.operators import dots as D
from dotloom.operators import geometry as G
from dotloom.operators import groups as Q
from dotloom.operators import masks as M
from dotloom.operators import rle
from dotloom.operators import scoring as V
from dotloom.operators import splits as P
from dotloom.plans import catalog
from dotloom.sources import models
from dotloom.sources import synthetic as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "embeddings", "lineitem", "part"):
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = ",".join(sorted(df.columns))
    assert sorted(map(tuple, df.selectExpr(*cols.split(",")).collect()), key=str) == sorted(duck.sql(f"SELECT {cols} FROM ({catalog.ORACLE_SQL[name]})").fetchall(), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_dots_round_half_to_even_and_leave_the_image(spark):
    d = spark.createDataFrame([(1, 1, 0.5, 1.5), (1, 2, 2.5, 63.5), (1, 3, -0.6, 0.0)], "image_id long, dot_id long, x double, y double")
    assert [tuple(r) for r in D.in_bounds(d, 64).collect()] == [(1, 1, 0, 2)]


@pytest.mark.parametrize(("n", "name"), [(10, "0-10"), (11, "11-20"), (20, "11-20"), (21, "21-50"), (50, "21-50"), (51, "51-100"), (100, "51-100"), (101, "100+")])
def test_bin_edges(spark, n, name):
    assert spark.range(1).selectExpr(f"{n} AS n").select(D.density_bin("n")).first()[0] == name


def test_match_without_truth_is_background(spark):
    c = spark.createDataFrame([(1, 1)], "image_id long, cand_id long")
    r = spark.createDataFrame([(1, 1, 0, 0, 4)], "image_id long, cand_id long, y long, xs long, xe long")
    g = spark.createDataFrame([], "image_id long, gt_id long, label long")
    gr = spark.createDataFrame([], "image_id long, gt_id long, y long, xs long, xe long")
    row = M.match(c, r, g, gr).first()
    assert (row.matched_class, row.valid, row.label_type, row.iou) == (-1, 0, "background", 0.0)


def _squares(spark, *sizes):
    """Square candidates 1, 2, ... of one image at (0, 0), full masks."""
    c = spark.createDataFrame([(1, k, 0, 0, n, n, 0.5) for k, n in enumerate(sizes, 1)], "image_id long, cand_id long, x1 long, y1 long, w long, h long, score double")
    r = spark.createDataFrame([(1, k, y, 0, n) for k, n in enumerate(sizes, 1) for y in range(n)], "image_id long, cand_id long, y long, xs long, xe long")
    return c, r


def test_area_and_box_bounds_are_inclusive(spark):
    c, r = _squares(spark, 4, 3, 8, 32)
    ids = lambda *a, **k: sorted(x.cand_id for x in M.sized(c, r, *a, **k).collect())
    assert ids(64, 64) == [1, 3, 4]
    assert ids(32, 32) == [1, 3]  # the whole image is above 0.95
    assert ids(64, 64, lo=16 / 4096, hi=64 / 4096) == [1, 3]
    assert ids(64, 64, min_score=0.6) == ids(0, 64) == []
    thin = r.where("y = 0")
    assert sorted(x.cand_id for x in M.sized(c, thin, 64, 64, lo=9 / 4096).collect()) == [4]  # the mask's area counts, not the box's


def test_duplicates_of_a_removed_candidate_stay(spark):
    c, r = _squares(spark, 20, 20, 18)
    assert [x.cand_id for x in M.filter_candidates(c, r, 64, 64).collect()] == [1, 3]
    assert [x.cand_id for x in M.filter_candidates(c, r, 64, 64, cap=1).collect()] == [1]


def test_clipping_truncates_toward_zero(spark):
    rows = [(1, -3.9, 2.9, 70.0, 2.95), (2, 63.9, 80.0, 63.9, 90.0), (3, 10.2, 10.2, 14.9, 18.9)]
    d = G.context_boxes(spark.createDataFrame(rows, "cand_id long, x1 double, y1 double, x2 double, y2 double").withColumns({"width": F.lit(64), "height": F.lit(64)}))
    got = {r.cand_id: tuple(r[c] for c in (*G.BOX, "cx1", "cy1", "cx2", "cy2")) for r in d.collect()}
    assert got == {1: (0, 2, 64, 3, 0, 2, 64, 3), 2: (63, 63, 64, 64, 63, 63, 64, 64), 3: (10, 10, 14, 18, 8, 6, 16, 22)}


def test_run_length_code():
    # Fixed values of the format: a 3 x 3 mask with its middle set, and a full one.
    assert rle.counts_text([4, 1, 4]) == "414" and rle.counts_text([0, 9]) == "09"
    rng = np.random.default_rng(1)
    for _ in range(100):
        h, w = rng.integers(1, 40, 2).tolist()
        mask = rng.random((h, w)) < rng.random()
        edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(int), axis=1)
        runs = [(int(y), int(a), int(b)) for (y, a), (_, b) in zip(np.argwhere(edge == 1), np.argwhere(edge == -1), strict=True)]
        counts = rle.column_counts(runs, h, w)
        assert rle.text_counts(rle.counts_text(counts)) == counts and rle.row_runs(counts, h, w) == runs
    for bad in ("P", "4"):
        with pytest.raises(ValueError):
            rle.row_runs(rle.text_counts(bad), 3, 3)


def test_splits_are_disjoint_and_of_the_stated_size(spark):
    d = spark.range(37).select(F.col("id").alias("k")).crossJoin(spark.range(3).select("id"))
    for ratio, n in ((0.1, 3), (0.0, 1), (0.5, 18), (1.0, 37)):
        train, val = P.split(d, "k", ratio, 5)
        a, b = {r.k for r in train.collect()}, {r.k for r in val.collect()}
        assert len(b) == n and not a & b and len(a | b) == 37 and val.count() == 3 * n
    assert {r.k for r in P.split(d, "k", 0.5, 6)[1].collect()} != {r.k for r in P.split(d, "k", 0.5, 5)[1].collect()}
    assert P.validation_keys(d.limit(0), "k", 0.5).count() == 0


def test_patience_zero_never_stops(spark):
    m = spark.createDataFrame([(1, e, v) for e, v in enumerate([0.1, 0.3, 0.2, 0.3, 0.2, 0.4])], "run long, epoch long, metric double")
    assert [r.improved for r in V.early_stop(m, 0).orderBy("epoch").collect()] == [True, True, False, False, False, True]
    assert V.early_stop(m, 2).count() == 4


def test_class_table_in_blocks_scores_alike(spark, monkeypatch):
    d = X.candidates(spark, 60, 6, 5).withColumnRenamed("matched_class", "label")
    means = V.class_means(d)
    linear = means.where("class_idx < 3").select("class_idx", F.col("mu").alias("w"), F.lit(0.25).alias("b"))
    run = lambda: {r.cand_id: [[round(x, 9) for x in s] for s in r.scores] for r in V.head_scores(d, means, linear).collect()}
    whole = run()
    monkeypatch.setattr(V, "MOST_BYTES", 100)
    assert len(V.class_rows(means.withColumns({"w": F.lit(None).cast("array<double>"), "b": F.lit(0.0)}))) > 2
    assert run() == whole and {s[3] for r in whole.values() for s in r if s[0] > 2} == {0.0}
    with pytest.raises(ValueError):
        V.with_head(d, "other")


def test_projection_and_losses_equal_numpy(spark):
    rng = np.random.default_rng(3)
    layers = [(rng.normal(size=(5, 6)).tolist(), rng.normal(size=5).tolist()), (rng.normal(size=(4, 5)).tolist(), rng.normal(size=4).tolist())]
    d = X.candidates(spark, 20, 6, 3)
    z = {r.cand_id: np.array(r.z) for r in d.collect()}
    for r in V.projected(d, layers).collect():
        x = np.array(layers[0][0]) @ z[r.cand_id] + layers[0][1]
        x = np.array(layers[1][0]) @ (x * 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))) + layers[1][1]
        assert np.allclose(r.h, x)
    scores = [(0, 2.0), (1, -1.0), (2, 0.5)]
    row = spark.createDataFrame([([{"class_idx": c, "s": s} for c, s in scores], 2, {0: 0.5, 1: 2.0, 2: 1.5})], "scores array<struct<class_idx:bigint,s:double>>, t bigint, w map<bigint,double>")
    lse = math.log(sum(math.exp(s / 0.5) for _, s in scores))
    weight = [0.5, 2.0, 1.5]
    want = 0.9 * 1.5 * (lse - 1.0) + 0.1 / 3 * sum(w * (lse - s / 0.5) for w, (_, s) in zip(weight, scores, strict=True))
    got = row.select(V.cross_entropy("s", "t", 0.5, 0.1, "w").alias("a"), V.cross_entropy("s", "t", 0.5).alias("b"), V.predicted("s").alias("p"), V.rank_of("s", "t").alias("r")).first()
    assert got.a == pytest.approx(want) and got.b == pytest.approx(lse - 1.0) and (got.p, got.r) == (0, 1)


def test_synthetic_candidates(spark):
    a, b = (X.candidates(spark, 2000, 4, 6, 9).repartition(n).orderBy("cand_id").collect() for n in (1, 5))
    assert a == b
    assert all(0.2 <= r.purity <= 1 and r.valid == (r.purity > 0.5) and r.is_countable == (r.matched_class < 3) for r in a)
    z = np.array([r.z for r in a])
    c = np.array([r.matched_class for r in a])
    assert all(abs((z[c == k] - z[c == k].mean(axis=0)).std() - 1) < 0.1 for k in range(6))
    u = X.load_prototypes(spark, None, 7, 5).collect()
    assert len(u) == 7 and all(sum(x * x for x in r.unit) == pytest.approx(1) for r in u)


def test_groups_split_merge_and_isolate(spark):
    sharp = lambda k: [0.94 if c == k else 0.03 for c in range(3)]
    rows = [(1, i, sharp(0 if i < 4 else 1), [0.0 if i < 4 else 3.0, float(i % 2) / 10], 1) for i in range(8)] + [(1, 8, [0.34, 0.33, 0.33], [9.0, 9.0], 0)]
    f = spark.createDataFrame([r[1:] for r in rows], "cand_id long, p array<double>, z array<double>, valid long")
    side = lambda i: i // 4
    pairs = spark.createDataFrame([(1, i, j, 0.9 if side(i) == side(j) else 0.01) for i in range(9) for j in range(i + 1, 9)], "image_id long, i long, j long, affinity double")
    one = spark.createDataFrame([(1, i, 0 if i < 8 else 8) for i in range(9)], "image_id long, cand_id long, group_id long")
    got = {r.cand_id: r.group_id for r in Q.split(one, f, pairs, 0.5).collect()}
    assert {got[i] for i in range(4)}.isdisjoint({got[i] for i in range(4, 8)})
    apart = spark.createDataFrame([(1, i, i - i % 2) for i in range(8)] + [(1, 8, 8)], "image_id long, cand_id long, group_id long")
    done = Q.refined(apart, f, pairs, 0.5).collect()
    assert {r.cand_id: r.group_id for r in done} == {i: 0 if i < 4 else 4 if i < 8 else 8 for i in range(9)}
    assert [r.cand_id for r in done if r.noise] == [8]


def test_components_of_a_long_chain(spark):
    n = 70
    order = list(range(n))
    random.Random(3).shuffle(order)
    nodes = spark.createDataFrame([(1, i) for i in range(n + 1)], "image_id long, cand_id long")
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)], "i long, j long")
    assert {(r.cand_id, r.group_id) for r in Q.components(nodes, edges).collect()} == {(i, 0) for i in range(n)} | {(n, n)}


def test_models_plug_in(spark):
    side = 16
    images = spark.createDataFrame([(3, side, side, bytearray(range(256)) * 3)], "image_id long, height int, width int, rgb binary")

    def generate(image, options):
        assert options["pred_iou_thresh"] == 0.7
        mask = np.zeros(image.shape[:2], bool)
        mask[2:8, 3:9] = True
        return [(mask, 0.9), (mask, 0.8), (np.zeros_like(mask), 0.7)]

    cand, runs = models.proposals(images, generate, models.MaskGenerator())
    assert [tuple(r) for r in cand.select("cand_id", "x1", "y1", "w", "h").collect()] == [(300_000, 3, 2, 6, 6)] and runs.count() == 6
    boxes = cand.selectExpr("image_id", "cand_id", "x1", "y1", "x1+w AS x2", "y1+h AS y2", f"{side} AS width", f"{side} AS height")
    crops = G.pixel_crops(images, G.context_boxes(boxes).join(runs.groupBy("image_id", "cand_id").agg(F.collect_list(F.struct("y", "xs", "xe")).alias("runs")), ["image_id", "cand_id"]))
    z = models.region_features(crops, lambda x: np.array([[i.size, i.max()] for i in x], float), 2).first().z
    assert z[0] == z[2] == 6 * 6 * 3 and z[4] == 12 * 11 * 3
    t = models.text_prototypes(spark.createDataFrame([(0, "ab"), (0, "cd"), (1, "e")], "class_idx long, prompt string"), lambda x: np.array([[len(p), 1.0] for p in x]))
    assert {r.class_idx: round(r.unit[0] / r.unit[1], 6) for r in t.collect()} == {0: 2.0, 1: 1.0}


def test_scalar_functions(spark):
    d = spark.createDataFrame([(0.25, 4.0, 0.0), (1.0, -3.0, 2.0)], "p double, x double, y double")
    got = d.select(N.sigmoid(F.col("x")).alias("s"), N.log_odds(F.col("p")).alias("l"), N.clamp(F.col("x"), -1, 1).alias("c"), N.ratio("x", "y").alias("r")).collect()
    assert got[0].s == pytest.approx(1 / (1 + math.exp(-4))) and got[0].l == pytest.approx(math.log(1 / 3)) and got[1].l == pytest.approx(math.log((1 - 1e-6) / 1e-6))
    assert [r.c for r in got] == [1, -1] and [r.r for r in got] == [0, -1.5]
