"""Counting inputs derived from the driver tables by integer arithmetic on ids, on a 64 x 64 canvas."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64


def _fl(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate boxes (image_id, cand_id, label, score, x1, y1, w, h): twelve to an image, three to a slot."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(
        "CAST(vec_id AS BIGINT) AS cand_id", "CAST(label AS BIGINT) AS label", f"{_fl('vec_id/12')} AS image_id", "vec_id%4 AS slot", f"{_fl('(vec_id%12)/4')} AS j"
    ).withColumn("s", F.expr("image_id*4+slot"))
    return e.selectExpr(
        "image_id", "cand_id", "label", "((cand_id*31)%97)/CAST(97 AS DOUBLE) AS score",
        "(slot%2)*28+(s*7)%4+CASE WHEN s%3=2 THEN j*3 ELSE 0 END AS x1", f"{_fl('slot/2')}*28+(s*5)%4 AS y1",
        "14+(s*11)%9 AS w", "14+(s*13)%9+CASE WHEN s%3=1 THEN j WHEN s%3=2 THEN 4*j ELSE 0 END AS h",
    )


def candidate_runs(cand: DataFrame) -> DataFrame:
    """Mask rows (image_id, cand_id, y, xs, xe) with a ragged left edge."""
    return cand.withColumn("y", F.explode(F.expr("sequence(y1, y1+h-1)"))).selectExpr("image_id", "cand_id", "y", "x1+(y-y1)%3 AS xs", "x1+w AS xe")


def truths(cand: DataFrame) -> DataFrame:
    """Ground-truth boxes (image_id, gt_id, label, x1, y1, w, h): every seventh candidate, moved, some enlarged."""
    return cand.where("cand_id%7=0").selectExpr("image_id", "cand_id AS gt_id", "label", "x1+2 AS x1", "y1+1 AS y1", "w-1+(cand_id%2)*11 AS w", "h+(cand_id%2)*12 AS h")


def truth_runs(gt: DataFrame) -> DataFrame:
    """Full rows of the ground-truth boxes, clipped to the canvas."""
    rows = gt.withColumn("y", F.explode(F.expr("sequence(y1, y1+h-1)"))).where(F.col("y") < SIDE)
    return rows.selectExpr("image_id", "gt_id", "y", "x1 AS xs", f"least(x1+w, {SIDE}) AS xe")


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dots (image_id, dot_id, x, y) with half-pixel positions, some outside the canvas."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        f"{_fl('sqrt(event_id/CAST(2 AS DOUBLE))')} AS image_id", "CAST(event_id AS BIGINT) AS dot_id", "value*0.5D AS x", "(event_id%131)*0.5D AS y"
    )


#: The same tables in DuckDB SQL.
SQL = """WITH cand AS (SELECT image_id, cand_id, label, ((cand_id*31)%97)/CAST(97 AS DOUBLE) AS score,
 (slot%2)*28+(s*7)%4+CASE WHEN s%3=2 THEN j*3 ELSE 0 END AS x1, CAST(floor(slot/2.0) AS BIGINT)*28+(s*5)%4 AS y1,
 14+(s*11)%9 AS w, 14+(s*13)%9+CASE WHEN s%3=1 THEN j WHEN s%3=2 THEN 4*j ELSE 0 END AS h
 FROM (SELECT *, image_id*4+slot AS s FROM (SELECT vec_id AS cand_id, CAST(label AS BIGINT) AS label, CAST(floor(vec_id/12.0) AS BIGINT) AS image_id, vec_id%4 AS slot, CAST(floor((vec_id%12)/4.0) AS BIGINT) AS j FROM embeddings))),
cand_run AS (SELECT image_id, cand_id, y, x1+(y-y1)%3 AS xs, x1+w AS xe FROM (SELECT *, unnest(generate_series(y1, y1+h-1)) AS y FROM cand)),
gt AS (SELECT image_id, cand_id AS gt_id, label, x1+2 AS x1, y1+1 AS y1, w-1+(cand_id%2)*11 AS w, h+(cand_id%2)*12 AS h FROM cand WHERE cand_id%7=0),
gt_run AS (SELECT image_id, gt_id, y, x1 AS xs, least(x1+w, 64) AS xe FROM (SELECT *, unnest(generate_series(y1, y1+h-1)) AS y FROM gt) WHERE y < 64),
dot AS (SELECT image_id, dot_id, CAST(round_even(x,0) AS BIGINT) AS xi, CAST(round_even(y,0) AS BIGINT) AS yi FROM
 (SELECT CAST(floor(sqrt(event_id/CAST(2 AS DOUBLE))) AS BIGINT) AS image_id, event_id AS dot_id, value*0.5 AS x, (event_id%131)*0.5 AS y FROM events)
 WHERE round_even(x,0)>=0 AND round_even(x,0)<64 AND round_even(y,0)>=0 AND round_even(y,0)<64),
"""
