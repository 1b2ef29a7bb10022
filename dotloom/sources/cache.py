"""Candidate caches as Parquet directories, and result files."""

import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dotloom.functions.scalars import round_half_even, stem
from dotloom.operators import rle

PROTOTYPES = "text_prototypes"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_caches(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of the caches that exist, duplicates kept; a warning for one that doesn't. Raises ValueError if none does."""
    found = []
    for p in paths:
        if (d := _read(spark, p)) is None:
            warnings.warn(f"no cache at {p}, left out", stacklevel=2)
        else:
            found.append(d)
    if not found:
        raise ValueError(f"no cache among {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def append_missing(rows: DataFrame, path: str, key: str = "image_id", overwrite: bool = False) -> None:
    """Adds the images that the cache lacks; with ``overwrite`` writes it anew. Rows of a null key are always added."""
    old = None if overwrite else _read(rows.sparkSession, path)
    if old is not None:
        rows = rows.join(old.select(key).distinct(), key, "left_anti")
    rows.write.mode("overwrite" if overwrite else "append").parquet(path)


def files_in(spark: SparkSession, *directories: str, suffix: str = ".pt") -> DataFrame:
    """(directory, file) of the files with the suffix; their content is not read."""
    rows = [spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(d).select(F.lit(d).alias("directory"), F.element_at(F.split("path", "/"), -1).alias("file")) for d in directories]
    return reduce(DataFrame.union, rows)


def first_files(files: DataFrame, limit: int = 0) -> DataFrame:
    """(directory, file): the first ``limit`` of each directory by name (0: all), without the prototypes' file."""
    some = files.where(stem("file") != PROTOTYPES)
    if limit <= 0:
        return some
    w = Window.partitionBy("directory").orderBy("file")
    return some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("place")


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """``rows`` with each of the columns; one that is missing or null takes its default."""
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in rows.columns else F.lit(v) for k, v in defaults.items()})


def entries(cand: DataFrame, order: str, *fields: str) -> DataFrame:
    """One row an image: the order column and the fields of its candidates as arrays, in that order."""
    per = cand.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("c"))
    return per.select("image_id", *[F.col(f"c.{f}").alias(f) for f in (order, *fields)])


def candidates_of(cache: DataFrame, *fields: str) -> DataFrame:
    """The rows of ``entries`` again."""
    return cache.select("image_id", F.inline(F.arrays_zip(*fields)))


def mask_entries(runs: DataFrame, sizes: DataFrame, dots: DataFrame) -> DataFrame:
    """One row an image (img_id, file_name, gt_count, masks_rle, height, width), masks in the order of their ids.

    ``runs`` (image_id, cand_id, y, xs, xe), ``sizes`` (image_id, file_name, height, width), ``dots`` (image_id, ...).
    """
    m = rle.encode(runs, sizes.select("image_id", "height", "width"), "image_id", "cand_id")
    m = m.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("cand_id", "size", "counts"))).alias("m"))
    n = dots.groupBy("image_id").agg(F.count("*").alias("gt_count"))
    d = sizes.join(m, "image_id", "left").join(n, "image_id", "left")
    masks = F.coalesce(F.transform("m", lambda x: F.struct(x["size"].alias("size"), x["counts"].alias("counts"))), F.expr("CAST(array() AS array<struct<size:array<int>,counts:string>>)"))
    return d.select(stem("file_name").alias("img_id"), "file_name", F.coalesce("gt_count", F.lit(0)).alias("gt_count"), masks.alias("masks_rle"), "height", "width")


def write_detail(rows: DataFrame, path: str, ratio: str = "recall") -> None:
    """One JSON line a row, the ratio rounded to four digits by its exact value, ties to even."""
    rows.withColumn(ratio, round_half_even(F.col(ratio))).write.mode("overwrite").json(path)


def write_summary(totals: DataFrame, rows: DataFrame, path: str) -> None:
    """One directory of JSON lines for the totals (one row) and one for the rows; the rows are never gathered."""
    totals.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")


def table_text(rows: DataFrame, *columns: str, digits: int = 4) -> str:
    """The columns of a small table (bins and their total) as aligned text; ``-`` for null."""
    got = [[f"{v:.{digits}f}" if isinstance(v, float) else "-" if v is None else str(v) for v in r] for r in rows.select(*columns).collect()]
    width = [max(len(x) for x in c) for c in zip(columns, *got, strict=True)]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(r, width, strict=True)) for r in [columns, *got])


def write_head(linear: DataFrame, metrics: DataFrame, path: str) -> None:
    """A head's table (class_idx, w, b) and its one-row metadata."""
    linear.write.mode("overwrite").parquet(f"{path}/weights")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def read_head(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/weights"), spark.read.json(f"{path}/metrics")


def projection_layout(names: list[str]) -> dict:
    """Layers and dropout of a projection from the names of its weights (...mlp.<place>.weight): linear layers lie two places apart, or three with dropout."""
    for prefix in ("open_head.proj.mlp.", "proj.mlp."):
        at = sorted(int(n.removeprefix(prefix).split(".")[0]) for n in names if n.startswith(prefix) and n.endswith(".weight"))
        if at:
            break
    step = at[1] - at[0] if len(at) > 1 else 1
    return {"num_layers": len(at), "dropout": 0.1 if step >= 3 else 0.0}
