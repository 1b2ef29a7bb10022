import json
import os
import random

import pytest

from dotloom.functions import scalars as N
from dotloom.operators import rle
from dotloom.sources import annotations as A
from dotloom.sources import cache as C
from dotloom.streaming.incremental import build_cache


@pytest.fixture
def coco(tmp_path):
    p = tmp_path / "a.json"
    ann = [(1, 10, 7, [1, 2, 3, 4], 0), (2, 11, 3, [0, 0, 5, 5], 1), (3, 12, 3, [0, 0, 0, 5], 0), (4, 12, 3, [1, 1, 2, 2], 0)]
    p.write_text(json.dumps({
        "images": [{"id": i, "file_name": f"{i}.jpg", "height": 8, "width": 9} for i in (12, 11, 10)],
        "annotations": [dict(zip(("id", "image_id", "category_id", "bbox", "iscrowd"), a, strict=True)) for a in ann],
        "categories": [{"id": 7, "name": "b"}, {"id": 3, "name": "a"}],
    }, indent=1))
    return str(p)


def test_annotation_scan(spark, coco):
    assert {(r.category_id, r.class_idx) for r in A.classes(spark, coco).collect()} == {(3, 0), (7, 1)}
    assert sorted(r.id for r in A.images(spark, coco).collect()) == [10, 12]
    assert [r.id for r in A.images(spark, coco, 1).collect()] == [10]
    assert {(r.instance_id, r.class_idx, r.x2, r.y2) for r in A.instances(spark, coco).collect()} == {(1, 1, 4.0, 6.0), (4, 0, 3.0, 3.0)}


def test_dot_scan(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"x.jpg": {"points": [[0.5, 1], [2, 3]]}, "y.jpg": {"points": []}}))
    d = A.dot_file(spark, str(p))
    assert sorted(map(tuple, d.collect())) == [("x.jpg", 0, 0.5, 1.0), ("x.jpg", 1, 2.0, 3.0)]
    assert A.allowed(d, spark.createDataFrame([("y.jpg",)], "file_name string")).count() == 0


def test_cache_keeps_what_is_there(spark, tmp_path):
    p = str(tmp_path / "c")
    rows = lambda v, *ids: spark.createDataFrame([(i, v) for i in ids], "image_id long, v long")
    C.append_missing(rows(1, 1, 2), p)
    C.append_missing(rows(2, 2, 3), p)
    assert sorted(map(tuple, C.read_caches(spark, p, str(tmp_path / "none")).collect())) == [(1, 1), (2, 1), (3, 2)]
    C.append_missing(rows(5, 1), p, overwrite=True)
    assert list(map(tuple, spark.read.parquet(p).collect())) == [(1, 5)]
    with pytest.raises(ValueError):
        C.read_caches(spark, str(tmp_path / "none"))
    assert rows(1, 42).select(N.cache_name().alias("n")).first().n == "000000000042"


def test_result_files(spark, tmp_path):
    rng = random.Random(2)
    values = [0.00125, 0.5, 0.03125, 0.09375, 0.00005, 0.99995, 1.0, 0.0, *[a / b for b in (7, 16, 32, 1999, 20_000) for a in range(0, b, 1 + b // 60)], *[rng.random() for _ in range(300)], *[(2 * k + 1) / 20_000 for k in range(300)]]
    C.write_detail(spark.createDataFrame([(str(k), v) for k, v in enumerate(values)], "file string, recall double"), str(tmp_path / "d"))
    assert {r.file: r.recall for r in spark.read.json(str(tmp_path / "d")).collect()} == {str(k): round(v, 4) for k, v in enumerate(values)}


def test_records_need_a_file_and_a_fitting_mask(spark, coco):
    inst = A.instances(spark, coco)
    kind = "image_id long, instance_id long, height int, width int, y long, xs long, xe long"
    rows = [(10, 1, 8, 9, 2, 1, 4), (12, 4, 9, 9, 1, 1, 3)]
    files = lambda *n: spark.createDataFrame([(f"{i}.jpg",) for i in n], "file_name string")
    run = lambda rows, f: sorted((r.instance_id, r.area) for r in A.records(A.images(spark, coco), inst, spark.createDataFrame(rows, kind), f).collect())
    assert run(rows, files(10, 12)) == [(1, 3)]  # 4 has a mask of another size
    assert run([*rows, (12, 4, 8, 9, 1, 1, 1), (12, 4, 8, 9, 2, 1, 2)], files(12)) == [(4, 1)]
    assert run(rows, files(12)) == []


def test_files_names_and_defaults(spark, tmp_path):
    for n in ("b.pt", "a.pt", "text_prototypes.pt", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    f = C.files_in(spark, str(tmp_path))
    assert [r.file for r in C.first_files(f, 1).collect()] == ["a.pt"] and sorted(r.file for r in C.first_files(f).collect()) == ["a.pt", "b.pt"]
    names = ["a.b.jpg", "noext", ".hidden", "dir.x/file", "x."]
    d = spark.createDataFrame([(n,) for n in names], "file string")
    assert [r.s for r in d.select(N.stem("file").alias("s")).collect()] == [os.path.splitext(n)[0] for n in names]
    d = spark.createDataFrame([("", 1), (None, 2), ("q.png", 3)], "file_name string, image_id long")
    assert [r.f for r in d.select(N.image_file().alias("f")).collect()] == ["1.jpg", "2.jpg", "q.png"]
    got = C.with_defaults(d, {"file_name": "none", "gt_count": 0}).collect()
    assert [(r.file_name, r.gt_count) for r in got] == [("", 0), ("none", 0), ("q.png", 0)]


def test_cache_entries_and_mask_entries_round_trip(spark):
    d = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.25), (2, 3, 1.0)], "image_id long, cand_id long, purity double")
    e = C.entries(d, "cand_id", "purity")
    assert {r.image_id: list(r.purity) for r in e.collect()} == {1: [0.25, 0.5], 2: [1.0]}
    assert sorted(map(tuple, C.candidates_of(e, "cand_id", "purity").collect())) == sorted(map(tuple, d.collect()))
    runs = spark.createDataFrame([(1, 5, 0, 1, 3), (1, 5, 2, 0, 4), (1, 4, 1, 1, 2)], "image_id long, cand_id long, y long, xs long, xe long")
    sizes = spark.createDataFrame([(1, "one.jpg", 3, 4), (2, "two.jpg", 3, 4)], "image_id long, file_name string, height int, width int")
    dots = spark.createDataFrame([(1,), (1,)], "image_id long")
    m = {r.img_id: r for r in C.mask_entries(runs, sizes, dots).collect()}
    assert (m["one"].gt_count, m["two"].gt_count, len(m["one"].masks_rle), m["two"].masks_rle) == (2, 0, 2, [])
    assert [rle.row_runs(rle.text_counts(x.counts), *x["size"]) for x in m["one"].masks_rle] == [[(1, 1, 2)], [(0, 1, 3), (2, 0, 4)]]


def test_heads_and_tables(spark, tmp_path):
    w = spark.createDataFrame([(0, [1.0, 2.0], 0.5)], "class_idx long, w array<double>, b double")
    C.write_head(w, spark.createDataFrame([(3, 0.75)], "epoch long, top1 double"), str(tmp_path / "h"))
    head, meta = C.read_head(spark, str(tmp_path / "h"))
    assert head.collect() == w.collect() and meta.first().epoch == 3
    assert C.projection_layout([f"proj.mlp.{k}.{n}" for k in (0, 2, 4) for n in ("weight", "bias")]) == {"num_layers": 3, "dropout": 0.0}
    assert C.projection_layout(["open_head.proj.mlp.0.weight", "open_head.proj.mlp.3.weight", "closed_head.proj.mlp.0.weight"]) == {"num_layers": 2, "dropout": 0.1}
    text = C.table_text(spark.createDataFrame([("0-10", 3, 0.5), ("ALL", 3, None)], "bin string, images long, micro double"), "bin", "images", "micro")
    assert text.splitlines() == [" bin  images   micro", "0-10       3  0.5000", " ALL       3       -"]


def test_growing_cache(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("s", "o", "k"))
    for ids in ((1, 2), (2, 3)):
        spark.createDataFrame([(i,) for i in ids], "image_id long").coalesce(1).write.mode("append").parquet(src)
        build_cache(spark, src, "image_id long", out, ck).awaitTermination()
    assert sorted(r.image_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
