"""Elements of JSON documents by byte ranges, against the json module."""

import json
import random

import pytest

from dotloom.sources import annotations as A
from dotloom.sources.json_ranges import elements

NASTY = ["{", "}", "[", "]", '"', "\\", '\\"', "a{b}c", '{"k": [1, 2]}', ",", ":", "é🙂\n\t", "", "x" * 700 + "{{{", '"images":[{', "\\\\"]


def _document(rng, n):
    some = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randrange(4)))
    return {
        "info": {"a": [1, {"b": some()}], "c{": some()}, "images": [{"id": i, "file_name": some() + str(i), "height": 4, "width": 5} for i in range(n)],
        "annotations": [{"id": i, "image_id": i % max(n, 1), "category_id": 3, "bbox": [1.5, 2, 3, 4], "iscrowd": 0, "segmentation": {"counts": some(), "size": [4, 5]}, "note": [[], [{}], some()]} for i in range(2 * n)],
        "empty": [], "more": {"x": some(), "y": {"z": [some()]}}, "categories": [{"id": 3, "name": some()}],
    }


@pytest.fixture
def split_at(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield put
    for k, v in zip(("maxPartitionBytes", "openCostInBytes"), old, strict=True):
        spark.conf.set(f"spark.sql.files.{k}", v)


@pytest.mark.parametrize(("size", "indent"), [(97, None), (333, 2), (10_000_000, None)])
def test_elements_equal_the_json_module(spark, tmp_path, split_at, size, indent):
    rng = random.Random(size)
    docs = [_document(rng, n) for n in ((14, 3) if size < 10**6 else (14, 0, 40))]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=k == 0), encoding="utf-8")
    split_at(size)
    # Members of objects are no elements of an array: they have no key.
    got = [(r.key, json.loads(r.value)) for r in elements(spark, str(tmp_path), 2).collect() if r.key]
    arrays = [(k, x) for d in docs for k, v in d.items() if isinstance(v, list) for x in v]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, arrays))
    members = [json.loads("{" + r.value + "}") for r in elements(spark, str(tmp_path), 1).collect()]
    assert sorted(map(json.dumps, members)) == sorted(json.dumps({k: v}) for d in docs for k, v in d.items())


def test_scans_equal_at_any_split(spark, tmp_path, split_at):
    rng = random.Random(1)
    a, dots = tmp_path / "a.json", tmp_path / "dots.json"
    a.write_text(json.dumps(_document(rng, 30)))
    points = {"".join(rng.choice(NASTY[:-1]) for _ in range(2)) + f"{i}.jpg": {"points": [[i, j / 2] for j in range(i % 7)], "other": {"x": "{"}} for i in range(40)}
    # Two documents in one file.
    dots.write_text(json.dumps(points) + "\n" + json.dumps({"last.jpg": {"points": [[1, 2]]}}, indent=1))
    seen = []
    for size in (211, 10_000_000):
        split_at(size)
        seen.append([sorted(map(str, f.collect())) for f in (A.images(spark, str(a)), A.instances(spark, str(a)), A.classes(spark, str(a)), A.dot_file(spark, str(dots)))])
    assert seen[0] == seen[1] and [len(x) for x in seen[0]] == [30, 60, 1, sum(i % 7 for i in range(40)) + 1]
    split_at(211)
    assert spark.read.option("lineSep", "{").text(str(a)).rdd.getNumPartitions() > 8
