"""Dot operators: rounding, cover by masks, recall by density bin, count oracles."""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotloom.functions.scalars import ratio
from dotloom.operators import masks as M

#: Density bins in their order, with their highest count; counts beyond fall into the last.
BINS = (("0-10", 10), ("11-20", 20), ("21-50", 50), ("51-100", 100), ("100+", None))


def in_bounds(dots: DataFrame, sizes: DataFrame | int) -> DataFrame:
    """Dots at pixels, rounded half to even; those outside their image go.

    ``sizes`` is a table (image_id, height, width), or one side for all images. An image without size or pixels keeps no dot.
    """
    d = dots.select("image_id", "dot_id", F.rint("x").cast("long").alias("xi"), F.rint("y").cast("long").alias("yi"))
    if isinstance(sizes, int):
        d = d.withColumns({"height": F.lit(sizes), "width": F.lit(sizes)})
    else:
        d = d.join(sizes.select("image_id", "height", "width"), "image_id")
    return d.where("xi >= 0 AND xi < width AND yi >= 0 AND yi < height").select("image_id", "dot_id", "xi", "yi")


def density_bin(n: str) -> Column:
    """The closed density bin of a count."""
    got = F.when(F.col(n) <= BINS[0][1], BINS[0][0])
    for name, most in BINS[1:-1]:
        got = got.when(F.col(n) <= most, name)
    return got.otherwise(BINS[-1][0])


def hits(dots: DataFrame, runs: DataFrame, radius: int = 0) -> DataFrame:
    """Distinct (image_id, dot_id, cand_id) with the dot in the mask, dilated by a square of ``radius``; dots meet runs by row and tile of columns."""
    d = dots if not radius else dots.withColumn("yi", F.explode(F.expr(f"sequence(yi-{radius}, yi+{radius})")))
    d = d.withColumn("tile", F.floor(F.col("xi") / M.TILE))
    r = M.tiled(runs.withColumnRenamed("y", "yi"), more=radius)
    return d.join(r, ["image_id", "yi", "tile"]).where(f"xs-{radius} <= xi AND xi < xe+{radius}").select("image_id", "dot_id", "cand_id").distinct()


def recall_rows(dots: DataFrame, runs: DataFrame, radius: int = 0) -> DataFrame:
    """Per image: dots, and dots that the union of the masks (dilated by a square of ``radius``) covers."""
    union = M.tiled(M.union_runs(M.dilated(runs, radius))).withColumnsRenamed({"image_id": "ri", "y": "ry"})
    hit = (F.col("image_id") == F.col("ri")) & (F.col("yi") == F.col("ry")) & (F.floor(F.col("xi") / M.TILE) == F.col("tile")) & (F.col("xs") <= F.col("xi")) & (F.col("xi") < F.col("xe"))
    covered = dots.join(union, hit, "left_semi").groupBy("image_id").agg(F.count("*").alias("cov"))
    return dots.groupBy("image_id").agg(F.count("*").alias("dots")).join(covered, "image_id", "left").fillna(0, ["cov"])


def recall_by_bin(rows: DataFrame, total: bool = False) -> DataFrame:
    """Micro and macro recall by density bin, or over all images."""
    r = rows.withColumn("bin", F.lit("ALL") if total else density_bin("dots")).groupBy("bin")
    return r.agg(F.count("*").alias("images"), F.sum("dots").alias("dots"), F.round(F.sum("cov") / F.sum("dots"), 6).alias("micro"), F.round(F.avg(F.col("cov") / F.col("dots")), 6).alias("macro"))


def bin_table(spark) -> DataFrame:
    """(place, bin): all bins in order, and ALL."""
    return spark.createDataFrame([*enumerate(b for b, _ in BINS), (len(BINS), "ALL")], "place int, bin string")


def recall_table(rows: DataFrame, count: str = "dots") -> DataFrame:
    """(place, bin, images, dots, micro, macro) of every bin and ALL; bins without images have none and no recall. ``count`` picks the bin."""
    r = rows.withColumn("b", density_bin(count))
    got = r.rollup("b").agg(F.count("*").alias("images"), F.sum("dots").alias("dots"), (F.sum("cov") / F.sum("dots")).alias("micro"), F.avg(F.col("cov") / F.col("dots")).alias("macro"))
    got = got.select(F.coalesce("b", F.lit("ALL")).alias("bin"), "images", "dots", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))
    return F.broadcast(bin_table(rows.sparkSession)).join(got, "bin", "left").select("place", "bin", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("dots", F.lit(0)).alias("dots"), "micro", "macro")


def versus(new: DataFrame, old: DataFrame) -> DataFrame:
    """Recall rows of a new cache beside an old one's by image; an image that the old one lacks has no old recall."""
    o = old.select("image_id", F.col("dots").alias("old_dots"), F.col("cov").alias("old_cov"))
    both = new.join(o, "image_id", "left")
    return both.withColumns({"new_recall": F.round(ratio("cov", "dots"), 4), "old_recall": F.round(F.try_divide(F.col("old_cov"), F.col("old_dots")), 4)})


def versus_total(rows: DataFrame) -> DataFrame:
    """Micro recall of both caches over ``versus`` rows, each over the images that it has; null without dots."""
    return rows.agg(F.count("*").alias("images"), F.count("old_dots").alias("old_images"), F.round(F.try_divide(F.sum("cov"), F.sum("dots")), 6).alias("micro_new"), F.round(F.try_divide(F.sum("old_cov"), F.sum("old_dots")), 6).alias("micro_old"))


def scan_outcome(caches: DataFrame, annotated: DataFrame, inside: DataFrame) -> DataFrame:
    """(image_id, outcome) of each cached image: no_annotation (none, or without points), no_dot_in_image, or done."""
    a = annotated.select("image_id").distinct().withColumn("ann", F.lit(True))
    i = inside.select("image_id").distinct().withColumn("dot", F.lit(True))
    both = caches.select("image_id").distinct().join(a, "image_id", "left").join(i, "image_id", "left")
    return both.select("image_id", F.when(F.col("ann").isNull(), "no_annotation").when(F.col("dot").isNull(), "no_dot_in_image").otherwise("done").alias("outcome"))


def greedy_cover(cand: np.ndarray, dot: np.ndarray) -> int:
    """How many sets a greedy cover takes: the set of the most dots that are left, the lower id among equals, until none is left.

    Sets are rows of bits over the dots. Gains only fall, so an old gain bounds the new one: a set is counted again only
    when it comes first by its bound.
    """
    _, place = np.unique(dot, return_inverse=True)
    ids, row = np.unique(cand, return_inverse=True)
    n_dots = int(place.max(initial=-1)) + 1
    bits = np.zeros((len(ids), -(-n_dots // 64) or 1), np.uint64)
    np.bitwise_or.at(bits, (row, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    left = np.bitwise_or.reduce(bits, axis=0) if len(ids) else np.zeros(1, np.uint64)
    queue = [(-int(g), k) for k, g in enumerate(np.bitwise_count(bits).sum(axis=1))]
    heapq.heapify(queue)
    picks = 0
    while left.any():
        _, k = heapq.heappop(queue)
        now = (-int(np.bitwise_count(bits[k] & left).sum()), k)
        if queue and now > queue[0]:
            heapq.heappush(queue, now)
            continue
        left &= ~bits[k]
        picks += 1
    return picks


def count_oracle(dots: DataFrame, runs: DataFrame) -> DataFrame:
    """Per image: gt, covered dots and the greedy set-cover count (most remaining dots first, first set wins ties).

    An image's hits meet in one task: the work is as large as an image.
    """

    def cover(t: pa.Table) -> pa.Table:
        cand, dot = t.column("cand_id").to_numpy(), t.column("dot_id").to_numpy()
        return pa.table({"image_id": t.column("image_id")[:1], "pred_cover": pa.array([len(np.unique(dot))], pa.int64()), "pred_greedy": pa.array([greedy_cover(cand, dot)], pa.int64())})

    got = hits(dots, runs).select("image_id", "cand_id", "dot_id").groupBy("image_id").applyInArrow(cover, "image_id long, pred_cover long, pred_greedy long")
    return dots.groupBy("image_id").agg(F.count("*").alias("gt")).join(got, "image_id", "left").fillna(0, ["pred_cover", "pred_greedy"])


def errors(rows: DataFrame, gt: str, pred: str, *by: str) -> DataFrame:
    """MAE, RMSE and bias of pred - gt."""
    e = (F.col(pred) - F.col(gt)).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(e), 6).alias("bias"))


def oracle_by_bin(rows: DataFrame) -> DataFrame:
    """MAE and RMSE of both oracles and the mean recall of ``count_oracle`` rows, for each bin that has images."""
    cover, greedy = (F.col(c) - F.col("gt") for c in ("pred_cover", "pred_greedy"))
    r = rows.where("gt > 0").groupBy(density_bin("gt").alias("bin"))
    parts = [(f"{n}_mae", F.avg(F.abs(e))) for n, e in (("cover", cover), ("greedy", greedy))] + [(f"{n}_rmse", F.sqrt(F.avg(e * e))) for n, e in (("cover", cover), ("greedy", greedy))]
    return r.agg(F.count("*").alias("images"), *[F.round(c, 6).alias(n) for n, c in parts], F.round(F.avg(F.col("pred_cover") / F.col("gt")), 6).alias("recall"))
