"""Scans of annotation files: instance JSON and dot JSON, documents of any size, one or many to a file or folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.sources.json_ranges import elements

IMAGE = "struct<id:bigint,file_name:string,height:int,width:int>"
ANNOTATION = "struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,iscrowd:int>"
CATEGORY = "struct<id:bigint,name:string>"


def _rows(spark: SparkSession, path: str, array: str, schema: str) -> DataFrame:
    """The elements of one array of the documents, parsed by its schema; many tasks read a document."""
    return elements(spark, path, 2).where(F.col("key") == array).select(F.from_json("value", schema).alias("v")).select("v.*")


def classes(spark: SparkSession, path: str) -> DataFrame:
    """(category_id, name, class_idx): class ids without gaps, in the order of the category ids. The vocabulary is a small dimension."""
    c = _rows(spark, path, "categories", CATEGORY).distinct()
    ids = c.agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return c.crossJoin(F.broadcast(ids)).select(F.col("id").alias("category_id"), "name", (F.array_position("ids", F.col("id")) - 1).alias("class_idx"))


def images(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Images with an annotation that is no crowd; the first ``limit`` by id, or all."""
    used = _rows(spark, path, "annotations", ANNOTATION).where("coalesce(iscrowd, 0) = 0").select(F.col("image_id").alias("id"))
    table = _rows(spark, path, "images", IMAGE).join(used, "id", "left_semi")
    return table.orderBy("id").limit(limit) if limit > 0 else table


def instances(spark: SparkSession, path: str) -> DataFrame:
    """Boxes (image_id, instance_id, class_idx, x1, y1, x2, y2) that are no crowd, not empty and of a known class."""
    a = _rows(spark, path, "annotations", ANNOTATION).where("coalesce(iscrowd, 0) = 0 AND bbox[2] > 0 AND bbox[3] > 0")
    a = a.join(F.broadcast(classes(spark, path).select("category_id", "class_idx").distinct()), "category_id")
    return a.selectExpr("image_id", "id AS instance_id", "class_idx", "bbox[0] AS x1", "bbox[1] AS y1", "bbox[0]+bbox[2] AS x2", "bbox[1]+bbox[3] AS y2")


def records(images: DataFrame, instances: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """Instances that can be read: of images whose file is listed (``files``, file_name), with a mask that is not empty and fits the image.

    ``runs`` (image_id, instance_id, height, width, y, xs, xe) holds each mask's own size. An image without such an
    instance gives no row.
    """
    there = images.select(F.col("id").alias("image_id"), "file_name", F.col("height").alias("h"), F.col("width").alias("w")).join(files.select("file_name").distinct(), "file_name", "left_semi")
    area = runs.groupBy("image_id", "instance_id", "height", "width").agg(F.sum(F.col("xe") - F.col("xs")).alias("area")).where("area > 0")
    fit = area.join(there, "image_id").where("height = h AND width = w").select("image_id", "instance_id", "file_name", "area")
    return instances.join(fit, ["image_id", "instance_id"])


def dot_file(spark: SparkSession, path: str) -> DataFrame:
    """Dots (file_name, dot_id, x, y) of a JSON file keyed by file name."""
    member = F.concat(F.lit("{"), F.col("value"), F.lit("}"))
    m = elements(spark, path, 1).select(F.from_json(member, "map<string,struct<points:array<array<double>>>>").alias("m"))
    d = m.select(F.explode("m").alias("file_name", "v")).select("file_name", F.posexplode("v.points").alias("dot_id", "p"))
    return d.selectExpr("file_name", "CAST(dot_id AS BIGINT) AS dot_id", "p[0] AS x", "p[1] AS y")


def allowed(rows: DataFrame, names: DataFrame, key: str = "file_name") -> DataFrame:
    """Rows whose file name is listed."""
    return rows.join(names.select(key).distinct(), key, "left_semi")
