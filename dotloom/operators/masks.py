"""Mask operators over run-length rows (image_id, <id>, y, xs, xe): areas, overlaps, matching, suppression."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dotloom.functions.scalars import ratio


def areas(runs: DataFrame, key: str, name: str) -> DataFrame:
    """Area of each mask."""
    return runs.groupBy("image_id", key).agg(F.sum(F.col("xe") - F.col("xs")).alias(name))


#: Columns of a tile.
TILE = 64


def tiled(runs: DataFrame, left: str = "xs", right: str = "xe", more: int = 0) -> DataFrame:
    """``runs`` once for each tile of columns that they touch, ``more`` columns beyond both ends included; adds ``tile``."""
    first, last = F.floor((F.col(left) - more) / TILE), F.floor((F.col(right) - 1 + more) / TILE)
    return runs.where(F.col(left) < F.col(right)).withColumn("tile", F.explode(F.sequence(first, last)))


def intersections(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection area of each overlapping pair. Runs meet by row and tile of columns, so that a row of very many runs doesn't square; each tile counts its own part."""
    ids = [c for c in (*a.columns, *b.columns) if c.endswith("_id") and c != "image_id"]
    r = tiled(b.withColumnsRenamed({"xs": "xs2", "xe": "xe2"}), "xs2", "xe2")
    start = F.col("tile") * TILE
    part = F.least("xe", "xe2", start + TILE) - F.greatest("xs", "xs2", start)
    hit = tiled(a).join(r, ["image_id", "y", "tile"]).withColumn("part", part).where("part > 0")
    return hit.groupBy("image_id", *ids).agg(F.sum("part").alias("inter"))


def mask_overlaps(a: DataFrame, b: DataFrame, akey: str, bkey: str) -> DataFrame:
    """IoU, purity (share of a) and coverage (share of b) of overlapping pairs."""
    pairs = intersections(a, b).join(areas(a, akey, "area_a"), ["image_id", akey]).join(areas(b, bkey, "area_b"), ["image_id", bkey])
    return pairs.select("image_id", akey, bkey, "inter", (F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter"))).alias("iou"), ratio("inter", "area_a").alias("purity"), ratio("inter", "area_b").alias("coverage"))


def match(cand: DataFrame, runs: DataFrame, gt: DataFrame, gt_runs: DataFrame, tau_purity: float = 0.5, tau_part: float = 0.5) -> DataFrame:
    """Best ground truth of every candidate by IoU (first wins ties); background where no purity reaches ``tau_purity``."""
    pair = mask_overlaps(runs, gt_runs, "cand_id", "gt_id").join(gt.select("image_id", "gt_id", F.col("label").alias("gt_class")), ["image_id", "gt_id"])
    best = pair.groupBy("image_id", "cand_id").agg(F.min_by(F.struct("gt_id", "gt_class", "iou", "purity", "coverage"), F.struct(-F.col("iou"), "gt_id")).alias("b"), F.max("purity").alias("max_purity"))
    ok = F.coalesce(F.col("max_purity") >= tau_purity, F.lit(False))
    return cand.select("image_id", "cand_id").join(best, ["image_id", "cand_id"], "left").select(
        "image_id", "cand_id",
        F.coalesce("b.iou", F.lit(0.0)).alias("iou"), F.coalesce("b.purity", F.lit(0.0)).alias("purity"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"),
        F.when(ok, F.col("b.gt_class")).otherwise(-1).cast("long").alias("matched_class"), F.when(ok, F.col("b.gt_id")).otherwise(-1).cast("long").alias("matched_instance_id"),
        ok.cast("long").alias("valid"),
        F.when(~ok, "background").when((F.col("b.coverage") < tau_part) & (F.col("b.purity") >= tau_purity), "part").otherwise("valid").alias("label_type"),
    )


def box_iou(a: str, b: str) -> Column:
    """IoU of two boxes given as struct columns with x1, y1, w, h."""
    ix = F.expr(f"greatest(0, least({a}.x1+{a}.w, {b}.x1+{b}.w) - greatest({a}.x1, {b}.x1))")
    iy = F.expr(f"greatest(0, least({a}.y1+{a}.h, {b}.y1+{b}.h) - greatest({a}.y1, {b}.y1))")
    return F.try_divide(ix * iy, F.expr(f"{a}.w*{a}.h + {b}.w*{b}.h") - ix * iy)


def near_boxes(cand: DataFrame, box: float) -> DataFrame:
    """Pairs (image_id, cand_id, other_id), cand_id < other_id, of boxes (x1, y1, w, h) with an IoU above ``box``, which is above 0.

    Such boxes differ in width and in height by the factor 1 / box at most, and in their place by 1 - box of the larger
    side. So each box is laid on grids of the scales (powers of two) from its own to that of the largest partner; a pair
    meets once, on the grid of the larger width and the larger height, in the same or a near cell.
    """
    scales, reach = max(1, math.ceil(math.log2(1 / box))), max(1, math.ceil(2 * (1 - box)))
    bits = lambda x: (F.length(F.bin(F.col(x).cast("long"))) - 1).alias(f"{x}_bits")
    c = cand.where("w > 0 AND h > 0").select("image_id", "cand_id", F.struct("x1", "y1", "w", "h").alias("b"), "x1", "y1", bits("w"), bits("h"))
    steps = lambda n, a=0: F.sequence(F.lit(a), F.lit(n))
    c = c.withColumn("i", F.explode(steps(scales))).withColumn("j", F.explode(steps(scales))).withColumns({"i": F.col("i") + F.col("w_bits"), "j": F.col("j") + F.col("h_bits")})
    c = c.withColumns({"cx": F.floor(F.col("x1") / F.pow(F.lit(2.0), "i")), "cy": F.floor(F.col("y1") / F.pow(F.lit(2.0), "j"))})
    home = c.select("image_id", "i", "j", "cx", "cy", F.col("cand_id").alias("other_id"), F.col("b").alias("o"), F.col("w_bits").alias("ow"), F.col("h_bits").alias("oh"))
    seek = c.withColumn("dx", F.explode(steps(reach, -reach))).withColumn("dy", F.explode(steps(reach, -reach))).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")})
    met = seek.join(home, ["image_id", "i", "j", "cx", "cy"]).where((F.col("cand_id") < F.col("other_id")) & (F.col("i") == F.greatest("w_bits", "ow")) & (F.col("j") == F.greatest("h_bits", "oh")))
    return met.where(box_iou("b", "o") > box).select("image_id", "cand_id", "other_id")


def duplicates(cand: DataFrame, runs: DataFrame, box: float = 0.5, mask: float = 0.9) -> DataFrame:
    """Directed pairs (image_id, cand_id, other_id) with box IoU > ``box`` and mask IoU > ``mask``.

    Boxes come first and each pair once; masks meet for pairs of close boxes alone.
    """
    near = near_boxes(cand, box)
    left = near.join(runs, ["image_id", "cand_id"])
    right = runs.select("image_id", F.col("cand_id").alias("other_id"), "y", F.col("xs").alias("xs2"), F.col("xe").alias("xe2"))
    hit = left.join(right, ["image_id", "other_id", "y"]).where("xs < xe2 AND xs2 < xe")
    inter = hit.groupBy("image_id", "cand_id", "other_id").agg(F.sum(F.least("xe", "xe2") - F.greatest("xs", "xs2")).alias("inter"))
    size = areas(runs, "cand_id", "area_a")
    both = inter.join(size, ["image_id", "cand_id"]).join(size.withColumnsRenamed({"cand_id": "other_id", "area_a": "area_b"}), ["image_id", "other_id"])
    same = both.where(ratio(F.col("inter"), F.col("area_a") + F.col("area_b") - F.col("inter")) > mask).select("image_id", "cand_id", "other_id")
    return same.union(same.select("image_id", "other_id", "cand_id"))


def suppress(cand: DataFrame, runs: DataFrame, cap: int = 0) -> DataFrame:
    """Greedy near-duplicate suppression by score within each image; a duplicate of a removed candidate stays."""
    dups = duplicates(cand, runs).groupBy("image_id", "cand_id").agg(F.collect_list("other_id").alias("dups"))
    rows = cand.join(dups, ["image_id", "cand_id"], "left").withColumn("dups", F.coalesce("dups", F.expr("filter(array(cand_id), z -> false)")))
    arr = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "cand_id", "dups"))).alias("arr"))
    kept = arr.select("image_id", F.expr("aggregate(arr, filter(array(image_id), z -> false), (acc, b) -> CASE WHEN arrays_overlap(acc, b.dups) THEN acc ELSE concat(acc, array(b.cand_id)) END)").alias("kept"))
    if cap > 0:
        kept = kept.withColumn("kept", F.slice("kept", 1, cap))
    return kept.select("image_id", F.explode("kept").alias("cand_id"))


def sized(cand: DataFrame, runs: DataFrame, height: int | str, width: int | str, lo: float = 1e-4, hi: float = 0.95, least: int = 4, min_score: float = 0.0) -> DataFrame:
    """Candidates with a mask, its share of the image in [lo, hi], a box of at least ``least`` pixels each way and enough score; none of an image without pixels.

    ``height`` and ``width`` name columns of ``cand``, so that each image has its own, or are numbers for all images.
    """
    h, w = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (height, width))
    pixels = (h.cast("double") * w).alias("pixels")
    c = cand.where((h > 0) & (w > 0)).join(areas(runs, "cand_id", "mask_area"), ["image_id", "cand_id"]).where(F.col("mask_area") > 0)
    return c.where((F.col("mask_area") / pixels).between(lo, hi) & (F.col("w") >= least) & (F.col("h") >= least) & (F.col("score") >= min_score)).drop("mask_area")


def filter_candidates(cand: DataFrame, runs: DataFrame, height: int | str, width: int | str, cap: int = 0, **bounds: float) -> DataFrame:
    """(image_id, cand_id): ``sized`` candidates without near duplicates, at most ``cap`` an image, the best scores first."""
    some = sized(cand, runs, height, width, **bounds)
    return suppress(some, runs.join(some.select("image_id", "cand_id"), ["image_id", "cand_id"], "left_semi"), cap)


def top_by(cand: DataFrame, score: str, n: int) -> DataFrame:
    """The n candidates of each image with the highest score, the lower id first among equals; all for n <= 0."""
    if n <= 0:
        return cand
    w = Window.partitionBy("image_id").orderBy(F.desc(score), "cand_id")
    return cand.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")


def dilated(runs: DataFrame, radius: int) -> DataFrame:
    """Runs grown by a square of ``radius``; overlaps remain."""
    if radius <= 0:
        return runs
    return runs.withColumn("y", F.explode(F.expr(f"sequence(y-{radius}, y+{radius})"))).withColumns({"xs": F.col("xs") - radius, "xe": F.col("xe") + radius})


def union_runs(runs: DataFrame) -> DataFrame:
    """Disjoint runs of the union of all masks of an image."""
    w = Window.partitionBy("image_id", "y").orderBy("xs", "xe")
    head = F.coalesce(F.col("xs") > F.max("xe").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("long")
    part = runs.withColumn("head", head).withColumn("part", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("image_id", "y", "part").agg(F.min("xs").alias("xs"), F.max("xe").alias("xe")).drop("part")
