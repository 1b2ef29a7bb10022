"""Images of unequal, oblong sizes; one model run an image; bins without images."""

import random

import numpy as np

from dotloom.operators import dots as D
from dotloom.operators import masks as M
from dotloom.sources import models
from dotloom.sources.store import kept

SIZES = {1: (384, 578), 2: (578, 384), 3: (0, 50), 4: (10, 7)}


def _sizes(spark):
    return spark.createDataFrame([(i, h, w) for i, (h, w) in SIZES.items()], "image_id long, height int, width int")


def test_dots_stay_inside_their_own_image(spark):
    dots = [(1, 1, 500.0, 100.0), (1, 2, 100.0, 500.0), (2, 3, 500.0, 100.0), (2, 4, 100.0, 500.0), (3, 5, 0.0, 0.0), (4, 6, 6.5, 9.4), (4, 7, 6.4, 9.5), (9, 8, 1.0, 1.0), (1, 9, 577.5, 0.0), (1, 10, 576.5, 383.4), (1, 11, -0.5, -0.5)]
    got = D.in_bounds(spark.createDataFrame(dots, "image_id long, dot_id long, x double, y double"), _sizes(spark))
    assert sorted(r.dot_id for r in got.collect()) == [1, 4, 6, 10, 11]


def test_shares_are_of_their_own_image(spark):
    cand = spark.createDataFrame([(i, i * 10 + k, 0, 0, 5, 5, 0.5) for i in SIZES for k in range(2)], "image_id long, cand_id long, x1 int, y1 int, w int, h int, score double").join(_sizes(spark), "image_id")
    runs = spark.createDataFrame([(i, i * 10 + k, y, 0, 5) for i in SIZES for k in range(2) for y in range(5)], "image_id long, cand_id long, y int, xs int, xe int")
    share = {i: 25 / (h * w) if h * w else None for i, (h, w) in SIZES.items()}
    for lo, hi in ((0.0, 1.0), (1e-4, 0.2), (0.2, 0.95)):
        want = sorted(i * 10 + k for i, s in share.items() if s is not None and lo <= s <= hi for k in range(2))
        assert sorted(r.cand_id for r in M.sized(cand, runs, "height", "width", lo, hi).collect()) == want
    # Of each image's two equal candidates one stays.
    assert sorted(r.cand_id for r in M.filter_candidates(cand, runs, "height", "width", lo=0.0, hi=1.0).collect()) == [10, 20, 40]


def test_the_model_runs_once_an_image(spark, tmp_path):
    log, rng = str(tmp_path / "calls"), random.Random(1)
    images = spark.createDataFrame([(i, h, w, bytearray(h * w * 3)) for i, (h, w) in SIZES.items() if h], "image_id long, height int, width int, rgb binary").repartition(3)

    def generate(image, options):
        with open(log, "a") as f:
            f.write(f"{image.shape[0]}x{image.shape[1]}\n")
        out = []
        for k in range(3):  # no two runs give the same
            mask = np.zeros(image.shape[:2], bool)
            mask[k : k + 4 + rng.randrange(2), : 4 + k] = True
            out.append((mask, rng.random()))
        return out

    cand, runs = models.proposals(images, generate, models.MaskGenerator(), lo=0.0, hi=1.0)
    for _ in range(2):
        boxes = {(r.cand_id, r.h) for r in cand.collect()}
        rows = runs.groupBy("cand_id").agg({"y": "count"}).collect()
        assert {(r.cand_id, r["count(y)"]) for r in rows} == boxes
    assert sorted(open(log).read().split()) == sorted(f"{h}x{w}" for h, w in SIZES.values() if h)


def test_bins_without_images_keep_their_row(spark):
    rows = spark.createDataFrame([(1, 5, 3), (2, 70, 7)], "image_id long, dots long, cov long")
    got = {r.bin: (r.images, r.dots) for r in D.recall_table(rows).collect()}
    assert got == {"0-10": (1, 5), "11-20": (0, 0), "21-50": (0, 0), "51-100": (1, 70), "100+": (0, 0), "ALL": (2, 75)}


def test_a_kept_table_goes_when_dropped(spark):
    t = kept(spark.range(5))
    assert t.df.count() == 5
    t.drop()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.path)
    assert not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
