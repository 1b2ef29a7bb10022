"""Synthetic candidates and prototypes for tests without caches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.functions.scalars import normalised


def candidates(spark: SparkSession, n: int, dim: int, classes: int, seed: int = 0) -> DataFrame:
    """(cand_id, z, matched_class, purity, valid, is_countable): Gaussian clusters around class centres three wide.

    Purity is uniform, clamped to [0.2, 1]; valid above 0.5; the lower half of the classes is countable. A row's numbers
    hang on its id and the seed alone, not on the partitioning.
    """

    def normal(name, k):  # Box and Muller over hashes
        u, v = ((F.pmod(F.xxhash64(F.col(name), F.lit(seed), F.lit(salt), k), F.lit(1 << 52)) + 0.5) / float(1 << 52) for salt in (1, 2))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)

    d = spark.range(n).withColumnRenamed("id", "cand_id")
    d = d.withColumn("matched_class", F.pmod(F.xxhash64("cand_id", F.lit(seed), F.lit(3)), F.lit(classes)))
    d = d.withColumn("purity", F.greatest(F.lit(0.2), F.pmod(F.xxhash64("cand_id", F.lit(seed), F.lit(4)), F.lit(1 << 52)) / float(1 << 52)))
    z = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: 3.0 * normal("matched_class", k) + normal("cand_id", k + F.lit(dim)))
    return d.select("cand_id", z.alias("z"), "matched_class", "purity", (F.col("purity") > 0.5).cast("long").alias("valid"), (F.col("matched_class") < classes // 2).cast("double").alias("is_countable"))


def load_prototypes(spark: SparkSession, path: str | None, classes: int = 0, dim: int = 0, seed: int = 123) -> DataFrame:
    """(class_idx, unit): the normalised table at ``path`` (class_idx, v); without a path, seeded random directions."""
    if path:
        return spark.read.parquet(path).select("class_idx", normalised(F.col("v").cast("array<double>")).alias("unit"))
    u = candidates(spark, classes, dim, max(classes, 1), seed).select(F.col("cand_id").alias("class_idx"), "z")
    return u.select("class_idx", normalised(F.col("z")).alias("unit"))
