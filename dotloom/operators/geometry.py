"""Box and crop geometry: clipping, context boxes, masked crops, geometry features, seed points, pixel crops."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """The box in whole pixels (truncated toward zero), inside the image and one pixel wide at least."""
    x1, y1, x2, y2 = (c.cast("long") for c in (x1, y1, x2, y2))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    x1, y1 = F.greatest(zero, F.least(x1, width - one)), F.greatest(zero, F.least(y1, height - one))
    return [x1, y1, F.greatest(x1 + one, F.least(x2, width)), F.greatest(y1 + one, F.least(y2, height))]


def clipped(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """``boxes`` with x1 to y2 clipped into the image."""
    got = clip_box(*[F.col(c) for c in BOX], F.col(width).cast("long"), F.col(height).cast("long"))
    return boxes.withColumns(dict(zip(BOX, got, strict=True)))


def context_boxes(boxes: DataFrame, expand: float = 0.5, width: str = "width", height: str = "height") -> DataFrame:
    """Clipped boxes with their context cx1 to cy2: the clipped box grown by a share of its size each way, clipped again."""
    b = clipped(boxes, width, height)
    ex, ey = ((F.col(q) - F.col(p)) * expand for p, q in (("x1", "x2"), ("y1", "y2")))
    ex, ey = ex.cast("long"), ey.cast("long")
    got = clip_box(F.col("x1") - ex, F.col("y1") - ey, F.col("x2") + ex, F.col("y2") + ey, F.col(width).cast("long"), F.col(height).cast("long"))
    return b.withColumns(dict(zip(("cx1", "cy1", "cx2", "cy2"), got, strict=True)))


def masked_crop(runs: DataFrame, boxes: DataFrame, *keys: str) -> DataFrame:
    """Mask runs inside the clipped boxes, in the box's own coordinates."""
    b = boxes.select(*keys, *BOX)
    hit = runs.join(b, list(keys)).where("y >= y1 AND y < y2 AND xs < x2 AND xe > x1")
    return hit.select(*keys, (F.col("y") - F.col("y1")).alias("y"), (F.greatest("xs", "x1") - F.col("x1")).alias("xs"), (F.least("xe", "x2") - F.col("x1")).alias("xe"))


def geometry_features(boxes: DataFrame, area: str = "area", width: str = "width", height: str = "height") -> DataFrame:
    """``boxes`` with eight features; width and height of a box count one pixel at least. Images without pixels go."""
    d = boxes.where(f"{width} * {height} > 0")
    bw, bh = (F.greatest((F.col(q) - F.col(p)).cast("double"), F.lit(1.0)) for p, q in (("x1", "x2"), ("y1", "y2")))
    w, h, a = (F.col(c).cast("double") for c in (width, height, area))
    return d.withColumns({
        "cx": (F.col("x1") + F.col("x2")) / 2.0 / w, "cy": (F.col("y1") + F.col("y2")) / 2.0 / h, "nw": bw / w, "nh": bh / h,
        "box_ratio": bw * bh / (w * h), "mask_ratio": a / (w * h), "aspect": bw / bh, "fill": a / (bw * bh),
    })


def seed_grid(spark: SparkSession, spacing: int, side: int = 384, layers: int = 0) -> DataFrame:
    """(layer, point_id, x, y): cell centres of a square grid over the unit image, one copy for each crop layer."""
    n = len(np.arange(spacing / side / 2.0, 1.0, spacing / side))
    e = spark.range((layers + 1) * n * n).selectExpr(f"CAST(floor(id/{n * n}) AS BIGINT) AS layer", f"id%{n * n} AS point_id")
    x, y = F.expr(f"point_id%{n}"), F.floor(F.col("point_id") / n)
    return e.select("layer", "point_id", *[((c + 0.5) * spacing / side).alias(k) for k, c in (("x", x), ("y", y))])


def pixel_crops(images: DataFrame, crops: DataFrame) -> DataFrame:
    """The masked, box and context crops of candidates as bytes.

    ``images`` has (image_id, height, width, rgb), rgb row-major with three bytes a pixel; ``crops`` (image_id, cand_id,
    x1 to y2, cx1 to cy2, runs), runs an array of (y, xs, xe) in the image. Rows of (cand_id, view, width, height, rgb).
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                pixels = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
                mask = np.zeros((r["height"], r["width"], 1), np.uint8)
                for m in r["runs"] or []:
                    mask[m["y"], m["xs"] : m["xe"]] = 1
                inner, outer = np.s_[r["y1"] : r["y2"], r["x1"] : r["x2"]], np.s_[r["cy1"] : r["cy2"], r["cx1"] : r["cx2"]]
                views = [("masked", (pixels * mask)[inner]), ("box", pixels[inner]), ("context", pixels[outer])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["cand_id"]] * 3, pa.int64()), pa.array([v for v, _ in views]), pa.array([c.shape[1] for _, c in views], pa.int32()), pa.array([c.shape[0] for _, c in views], pa.int32()), pa.array([c.tobytes() for _, c in views], pa.binary())],
                    ["cand_id", "view", "width", "height", "rgb"],
                )

    need = [*BOX, "cx1", "cy1", "cx2", "cy2"]
    both = crops.select("image_id", "cand_id", *need, "runs").join(images.select("image_id", "height", "width", "rgb"), "image_id")
    return both.mapInArrow(run, "cand_id long, view string, width int, height int, rgb binary")
