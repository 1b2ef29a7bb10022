"""Where neural models plug in: their calls as Arrow batches, and what surrounds them as operators.

A model is any callable on numpy arrays; weights and devices are its own affair.
"""

from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotloom.operators import masks as M
from dotloom.operators import scoring as V
from dotloom.sources.store import kept


@dataclass
class MaskGenerator:
    """Options of a mask generator, by the names that it takes."""

    points_per_batch: int = 1000
    points_per_crop: int = 16
    pred_iou_thresh: float = 0.7
    stability_score_thresh: float = 0.8
    stability_score_offset: float = 0.0
    mask_threshold: float = 0.0
    crops_n_layers: int = 1
    crop_overlap_ratio: float = 512 / 1500
    crop_n_points_downscale_factor: int = 1
    crops_nms_thresh: float = 0.7

    def options(self) -> dict:
        return asdict(self)


def generated(images: DataFrame, generate: Callable[[np.ndarray, dict], list[tuple[np.ndarray, float]]], config: MaskGenerator) -> tuple[DataFrame, DataFrame]:
    """Candidates (image_id, cand_id, x1, y1, w, h, score) and runs of ``generate(image, options)``: masks and scores of an image.

    ``images`` has (image_id, height, width, rgb); candidate ids are image_id * 100000 and the mask's place, empty masks go.
    What the model gives is written to the shared folder at once and read from there: it runs once an image, however often
    candidates and runs are used, and both are of one run also where the model isn't deterministic.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, h, w, rgb = (batch.column(c)[k].as_py() for c in ("image_id", "height", "width", "rgb"))
                rows = []
                for n, (mask, score) in enumerate(generate(np.frombuffer(rgb, np.uint8).reshape(h, w, 3), config.options())):
                    edge = np.diff(np.pad(np.asarray(mask, bool), ((0, 0), (1, 1))).astype(np.int8), axis=1)
                    (y, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                    rows += [(i, i * 100_000 + n, float(score), *map(int, r)) for r in zip(y, a, b, strict=True)]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["image_id", "cand_id", "score", "y", "xs", "xe"])

    rows = kept(images.select("image_id", "height", "width", "rgb").mapInArrow(run, "image_id long, cand_id long, score double, y long, xs long, xe long"), "generated").df
    box = rows.groupBy("image_id", "cand_id", "score").agg(F.min("xs").alias("x1"), F.min("y").alias("y1"), (F.max("xe") - F.min("xs")).alias("w"), (F.max("y") + 1 - F.min("y")).alias("h"))
    return box, rows.drop("score")


def proposals(images: DataFrame, generate, config: MaskGenerator, cap: int = 0, **bounds: float) -> tuple[DataFrame, DataFrame]:
    """``generated`` candidates that pass the filters, each by its own image's size, and the suppression of near duplicates; and their runs."""
    cand, runs = generated(images, generate, config)
    own = cand.join(images.select("image_id", "height", "width"), "image_id")
    some = kept(M.filter_candidates(own, runs, "height", "width", cap, **bounds), "proposals").df
    return cand.join(some, ["image_id", "cand_id"], "left_semi"), runs.join(some, ["image_id", "cand_id"], "left_semi")


def region_features(crops: DataFrame, encode: Callable[[list[np.ndarray]], np.ndarray], dim: int, batch: int = 32) -> DataFrame:
    """(cand_id, z): the encodings of the masked, box and context crop behind each other; ``encode`` takes up to ``batch`` images."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                size = zip(part.column("height").to_pylist(), part.column("width").to_pylist(), part.column("rgb").to_pylist(), strict=True)
                got = np.asarray(encode([np.frombuffer(x, np.uint8).reshape(h, w, 3) for h, w, x in size]), float)
                if got.shape != (part.num_rows, dim):
                    raise ValueError(f"encodings of shape {got.shape}, not {(part.num_rows, dim)}")
                yield pa.RecordBatch.from_arrays([part.column("cand_id"), part.column("view"), pa.array(got.tolist(), pa.list_(pa.float64()))], ["cand_id", "view", "v"])

    d = crops.select("cand_id", "view", "width", "height", "rgb").mapInArrow(run, "cand_id long, view string, v array<double>")
    per = d.groupBy("cand_id").agg(*[F.max(F.when(F.col("view") == v, F.col("v"))).alias(v) for v in ("masked", "box", "context")])
    return per.select("cand_id", F.concat("masked", "box", "context").alias("z"))


def text_prototypes(prompts: DataFrame, encode: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """(class_idx, mu, unit): the mean of the normalised encodings of a class's prompts (class_idx, prompt), normalised again."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = np.asarray(encode(part.column("prompt").to_pylist()), float)
                yield pa.RecordBatch.from_arrays([part.column("class_idx"), pa.array(got.tolist(), pa.list_(pa.float64()))], ["label", "z"])

    return V.class_means(prompts.select(F.col("class_idx").cast("long").alias("class_idx"), "prompt").mapInArrow(run, "label long, z array<double>"))
