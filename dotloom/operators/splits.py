"""Seeded splits by image and by class, and held-out classes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validation_keys(keys: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """max(1, int(n * ratio)) of the n distinct keys, by a seeded hash of each; none of an empty table.

    The hash is arithmetic modulo a prime, the same in any engine. A count by hash range (at most 2 ** 14 numbers) tells
    which ranges belong to it wholly, so that only the keys of one range are sorted.
    """
    prime, width = 2_147_483_647, 1 << 17
    h = F.pmod(F.pmod(F.col(key), F.lit(prime)) * 48271 + (seed + 1) * 69621, F.lit(prime)) * 16807 % prime
    d = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("hash", h).withColumn("range", F.floor(F.col("hash") / width))
    counts = sorted((r["range"], r["n"]) for r in d.groupBy("range").agg(F.count("*").alias("n")).collect())
    n, at = sum(c for _, c in counts), 0
    left = max(1, int(n * ratio)) if n else 0
    while at < len(counts) and counts[at][1] <= left:
        left -= counts[at][1]
        at += 1
    edge = counts[at][0] if at < len(counts) else 1 << 62
    return d.where(F.col("range") < edge).select(key).union(d.where(F.col("range") == edge).orderBy("hash", key).limit(left).select(key))


def split(rows: DataFrame, key: str, ratio: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, validation): all rows of a key fall on one side; rows of a null key train."""
    val = validation_keys(rows, key, ratio, seed)
    return rows.join(val, key, "left_anti"), rows.join(val, key, "left_semi")
