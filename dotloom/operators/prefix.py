"""Running sums over sorted rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dotloom.sources.store import kept


def running_sums(rows: DataFrame, by: list[str], order: Column, *values: str) -> DataFrame:
    """``rows`` with ``<value>_to`` for each value: its sum over the rows of the same ``by`` up to this one by ``order``.

    Rows equal in ``by`` and ``order`` must be one row. The rows are dealt to ranges by both, so a ``by`` of very many
    rows lies in several; each range adds up its own, and what a range's first ``by`` has in the ranges before is added
    to that. Only these sums, one row a range, go through the driver. Null values count 0.
    """
    d = rows.withColumn("__s", order)
    d = d.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], F.col("__s").asc_nulls_first()).withColumn("__part", F.spark_partition_id())
    dealt = kept(d, "ranges").df
    key = F.struct(*by, F.lit(0).alias("__0"))
    own = dealt.groupBy("__part", key.alias("__key")).agg(F.struct(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]).alias("sums"))
    ends = own.groupBy("__part").agg(F.min("__key").alias("first"), F.max("__key").alias("last"), F.max_by("sums", "__key").alias("sums"))
    offsets, carried, carry = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        before = carry if r.first == carried else [v * 0 for v in r.sums]
        if r.first == carried:
            offsets.append((r["__part"], *before))
        same = r.first == r.last == carried
        carried, carry = r.last, [x + (y if same else 0) for x, y in zip(r.sums, before, strict=True)]
    types = dict(own.select("sums.*").dtypes)
    table = rows.sparkSession.createDataFrame(offsets, "__at int, " + ", ".join(f"`__{v}` {types[v]}" for v in values))
    start = dealt.groupBy(F.col("__part").alias("__at")).agg(F.min(key).alias("__first")).join(table, "__at")  # a row a range
    d = dealt.join(F.broadcast(start), F.col("__part") == F.col("__at"), "left")
    w = Window.partitionBy("__part", *by).orderBy(F.col("__s").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    more = lambda v: F.when(F.col("__first") == key, F.col(f"__{v}")).otherwise(F.lit(0))
    return d.withColumns({f"{v}_to": F.sum(F.coalesce(v, F.lit(0))).over(w) + more(v) for v in values}).select(*rows.columns, *[f"{v}_to" for v in values])
