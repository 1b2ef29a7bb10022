"""The cache of one file an image: aborted, killed and repeated writes."""

import pathlib

import pytest
from pyspark.sql import functions as F

from dotloom.sources.image_cache import CacheWriter, commits, read_images, write_images

SCHEMA = "image_id long, cand_id long, counts string"


def _rows(spark, images, tag="a"):
    return spark.createDataFrame([(i, i * 10 + k, f"{tag}{i}") for i in images for k in range(3)], SCHEMA).repartition(4)


def _got(spark, path):
    return sorted(map(tuple, read_images(spark, path, SCHEMA).collect()))


def _files(path):
    return sorted(p.name for p in pathlib.Path(path).rglob("*.parquet"))


def test_each_image_once_and_those_there_are_kept(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert _got(spark, path) == []
    write_images(_rows(spark, range(5)), path)
    assert _files(path) == [f"{i}.parquet" for i in range(5)]
    write_images(_rows(spark, range(3, 8), "b"), path)
    assert _got(spark, path) == sorted((i, i * 10 + k, f"{'a' if i < 5 else 'b'}{i}") for i in range(8) for k in range(3))
    assert _files(path) == [f"{i}.parquet" for i in range(8)]
    write_images(_rows(spark, [2], "c"), path, overwrite=True)
    assert _got(spark, path) == [(2, 20 + k, "c2") for k in range(3)] and len(commits(path)) == 1


def test_an_aborted_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    write_images(_rows(spark, [1, 2]), path)
    before = _got(spark, path)
    # One image's task fails after others are written.
    bad = _rows(spark, range(1, 30)).withColumn("counts", F.when(F.col("image_id") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("counts")))
    with pytest.raises(Exception, match="broken"):
        write_images(bad, path)
    assert _got(spark, path) == before and len(commits(path)) == 1
    write_images(_rows(spark, range(1, 30)), path)
    assert [r[0] for r in _got(spark, path)] == sorted([i for i in range(1, 30)] * 3)


def test_a_killed_write_is_not_read_and_runs_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = _rows(spark, [1, 2])
    # A task has written, the driver dies before the commit.
    killed = CacheWriter(path, rows.schema, False)
    assert killed.write(iter(rows.coalesce(1).sortWithinPartitions("image_id").toArrow().to_batches())).images == 2
    assert _got(spark, path) == [] and _files(path) == ["1.parquet", "2.parquet"]
    write_images(rows, path)
    assert _got(spark, path) == sorted(map(tuple, rows.collect()))


def test_filters_on_images_open_their_files_alone(spark, tmp_path):
    path = str(tmp_path / "cache")
    write_images(_rows(spark, range(6)), path)
    for f in pathlib.Path(path).rglob("4.parquet"):
        f.write_bytes(b"unreadable")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        d = read_images(spark, path, SCHEMA)
        assert sorted(r.cand_id for r in d.where("image_id = 2 AND cand_id > 20").collect()) == [21, 22]
        assert d.where("image_id IN (1, 3)").count() == 6 and d.where("image_id = 99").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_no_rows_null_images_and_other_keys(spark, tmp_path):
    path = str(tmp_path / "cache")
    write_images(_rows(spark, [1]).limit(0), path)
    assert _got(spark, path) == []
    with pytest.warns(UserWarning, match="without image_id"):
        write_images(spark.createDataFrame([(None, 1, "x"), (3, 1, None)], SCHEMA), path)
    assert _got(spark, path) == [(3, 1, None)]
    with pytest.raises(ValueError, match="integer"):
        write_images(spark.createDataFrame([("a",)], "image_id string"), path)
