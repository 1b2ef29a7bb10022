"""Table functions through SQL."""

import random

import pytest

from dotloom.functions import tables
from dotloom.operators import rle


def _masks(spark):
    rng = random.Random(4)
    runs = [(i, c, y, x, x + 1 + rng.randrange(4)) for i in range(3) for c in range(4) for y in rng.sample(range(9), 4) for x in rng.sample(range(0, 12, 5), 2)]
    d = spark.createDataFrame(runs, "image_id long, cand_id long, y long, xs long, xe long")
    sizes = spark.createDataFrame([(i, 9, 17) for i in range(3)], "image_id long, height long, width long")
    return rle.encode(d, sizes, "image_id", "cand_id"), sizes


def test_runs_equal_those_of_decode(spark):
    masks, sizes = _masks(spark)
    tables.register(spark)
    masks.selectExpr("*", "concat('m', cand_id) AS name").createOrReplaceTempView("some_masks")
    got = spark.sql("SELECT image_id, cand_id, y, xs, xe FROM mask_runs(TABLE(some_masks)) WHERE name = concat('m', cand_id)")
    want = rle.decode(masks.join(sizes, "image_id"), "image_id", "cand_id")
    assert got.count() > 50 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_any_other_columns_and_masks_without_runs(spark):
    tables.register(spark)
    good = _masks(spark)[0].first()
    rows = [("a", [1.5], list(good["size"]), good["counts"]), (None, None, None, good["counts"]), ("b", [], list(good["size"]), None), ("c", [], [2, 2], "\x7f\x01"), ("d", [], [None, 2], good["counts"]), ("e", [], [2, 2], "")]
    spark.createDataFrame(rows, "`the key` string, more array<double>, size array<int>, counts string").createOrReplaceTempView("odd_masks")
    d = spark.sql("SELECT * FROM mask_runs(TABLE(odd_masks))")
    assert d.columns == ["the key", "more", "y", "xs", "xe"]
    assert {r["the key"] for r in d.collect()} == {"a"}
    assert spark.sql("SELECT * FROM mask_runs(TABLE(SELECT * FROM odd_masks WHERE false))").count() == 0


@pytest.mark.parametrize("query", ["SELECT 1 AS size, '' AS counts", "SELECT array(1, 1) AS size, '' AS counts, 1 AS y"])
def test_other_tables_are_errors(spark, query):
    tables.register(spark)
    with pytest.raises(Exception, match="mask_runs"):
        spark.sql(f"SELECT * FROM mask_runs(TABLE({query}))").collect()
