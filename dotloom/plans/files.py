"""Registered queries that write annotation files and caches derived from the driver tables, and read them by the scans; and their SQL checks."""

from pyspark.sql import functions as F

from dotloom.operators import dots as D
from dotloom.plans.registry import _inputs
from dotloom.sources import annotations as A
from dotloom.sources import cache as C
from dotloom.sources import derived as S
from dotloom.sources.image_cache import read_images, write_images
from dotloom.sources.store import scratch

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name, sql):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


#: Images of a document of the fixtures: their number grows with the tables, their size doesn't.
IMAGES = 20


def _annotation_file(spark, sf):
    """The truths as instance documents: category ids with gaps, some crowds, some boxes without width."""
    c = S.candidates(spark, sf)
    doc = F.floor(F.col("image_id") / IMAGES).alias("doc")
    a = S.truths(c).select(doc, F.struct(
        F.col("gt_id").alias("id"), "image_id", (F.col("label") * 3 + 5).alias("category_id"),
        F.array(*[F.expr(e).cast("double") for e in ("x1", "y1", "CASE WHEN gt_id%4=0 THEN 0 ELSE w END", "h")]).alias("bbox"), (F.col("gt_id") % 5 == 0).cast("int").alias("iscrowd"),
    ).alias("a"))
    i = c.select("image_id").distinct().select(doc, F.struct(F.col("image_id").alias("id"), F.format_string("im%d.jpg", "image_id").alias("file_name"), F.lit(S.SIDE).alias("height"), F.lit(S.SIDE).alias("width")).alias("i"))
    k = c.select(doc, F.struct((F.col("label") * 3 + 5).alias("id"), F.format_string("class_%d", "label").alias("name")).alias("k")).distinct()
    every = lambda d, x, name: d.groupBy("doc").agg(F.collect_list(x).alias(name))
    path = scratch(spark, "annotations")
    docs = every(i, "i", "images").join(every(a, "a", "annotations"), "doc", "left").join(every(k, "k", "categories"), "doc")
    docs.repartition(8, "doc").drop("doc").write.json(path)
    return path


PLAIN = S.SQL + "pl AS (SELECT * FROM gt WHERE gt_id%5<>0), ck AS (SELECT label, dense_rank() OVER (ORDER BY label)-1 AS class_idx FROM (SELECT DISTINCT label FROM cand))"


@_add("annotation_instances", PLAIN + "SELECT image_id, gt_id AS instance_id, class_idx, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x1+w AS DOUBLE) AS x2, CAST(y1+h AS DOUBLE) AS y2 FROM pl JOIN ck USING (label) WHERE gt_id%4<>0")
def annotation_instances(spark, sf):
    """Instances of annotation documents: no crowds, no empty boxes, classes without gaps."""
    return A.instances(spark, _annotation_file(spark, sf)).withColumn("class_idx", F.col("class_idx").cast("long"))


@_add("annotated_images", PLAIN + "SELECT image_id AS id, 'im' || image_id || '.jpg' AS file_name FROM (SELECT DISTINCT image_id FROM pl) ORDER BY image_id LIMIT 25")
def annotated_images(spark, sf):
    """The first 25 images that have an annotation which is no crowd."""
    return A.images(spark, _annotation_file(spark, sf), 25).select("id", "file_name")


@_add("contiguous_classes", PLAIN + "SELECT label*3+5 AS category_id, 'class_' || label AS name, class_idx FROM ck")
def contiguous_classes(spark, sf):
    return A.classes(spark, _annotation_file(spark, sf)).withColumn("class_idx", F.col("class_idx").cast("long"))


@_add("allowed_dots", """WITH d AS (SELECT CAST(floor(sqrt(event_id/CAST(2 AS DOUBLE))) AS BIGINT) AS image_id, event_id, value*0.5 AS x, (event_id%131)*0.5 AS y FROM events)
SELECT 'im' || image_id || '.jpg' AS file_name, row_number() OVER (PARTITION BY image_id ORDER BY event_id)-1 AS dot_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM d WHERE image_id%2=0""")
def allowed_dots(spark, sf):
    """Dots of JSON documents keyed by file name, of the files that a list allows."""
    d = S.dots(spark, sf).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("dot_id", "x", "y"))).alias("p"))
    d = d.select(F.format_string("im%d.jpg", "image_id").alias("name"), "image_id", F.struct(F.transform("p", lambda p: F.array(p["x"], p["y"])).alias("points")).alias("v"))
    path = scratch(spark, "dots")
    docs = d.groupBy(F.floor(F.col("image_id") / IMAGES).alias("doc")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "v")))).alias("value"))
    docs.repartition(8, "doc").select("value").write.text(path)
    names = d.where("image_id % 2 = 0").select(F.col("name").alias("file_name"))
    return A.allowed(A.dot_file(spark, path), names)


@_add("cache_union", """WITH i AS (SELECT DISTINCT CAST(floor(vec_id/12.0) AS BIGINT) AS image_id FROM embeddings)
SELECT image_id, lpad(CAST(image_id AS VARCHAR), 12, '0') AS name, CASE WHEN image_id%6=0 THEN 1 WHEN image_id%3=0 THEN 2 ELSE 3 END AS version FROM i WHERE image_id%3<2""")
def cache_union(spark, sf):
    """Two caches, one built in two goes that keep what is there, one written anew; read as one."""
    from dotloom.functions.scalars import cache_name

    i = S.candidates(spark, sf).select("image_id").distinct()
    rows = lambda where, v: i.where(where).withColumn("version", F.lit(v))
    a, b = scratch(spark, "cache"), scratch(spark, "cache")
    C.append_missing(rows("image_id % 6 = 0", 1), a)
    C.append_missing(rows("image_id % 3 = 0", 2), a)
    C.append_missing(rows("image_id % 2 = 0", 9), b)
    C.append_missing(rows("image_id % 3 = 1", 3), b, overwrite=True)
    return C.read_caches(spark, a, b).select("image_id", cache_name().alias("name"), "version")


@_add("dot_sets", S.SQL + """hit AS (SELECT DISTINCT d.image_id, d.dot_id, c.cand_id%2 AS side FROM dot d JOIN cand_run c ON c.image_id=d.image_id AND c.y=d.yi AND d.xi>=c.xs AND d.xi<c.xe), p AS (SELECT image_id, dot_id, bool_or(side=0) AS a, bool_or(side=1) AS b FROM hit GROUP BY 1,2)
SELECT image_id, count(*) AS in_either, count(*) FILTER (WHERE a AND b) AS in_both, count(*) FILTER (WHERE a AND NOT b) AS only_even FROM p GROUP BY 1""")
def dot_sets(spark, sf):
    """Union, intersection and difference of the dots that even and odd candidates cover."""
    _, runs, dots = _inputs(spark, sf)
    h = D.hits(dots, runs).groupBy("image_id").agg(*[F.collect_set(F.when(F.col("cand_id") % 2 == k, F.col("dot_id"))).alias(n) for k, n in ((0, "a"), (1, "b"))])
    size = lambda c: F.size(c).cast("long")
    return h.select("image_id", size(F.array_union("a", "b")).alias("in_either"), size(F.array_intersect("a", "b")).alias("in_both"), size(F.array_except("a", "b")).alias("only_even"))


@_add("image_cache", S.SQL + "y AS (SELECT 1) SELECT image_id, cand_id, score, x1, y1, w, h, CASE WHEN image_id%3=0 THEN 1 ELSE 2 END AS written FROM cand")
def image_cache(spark, sf):
    """A first write of some images, then one of all: those that are there keep their files."""
    d, at = S.candidates(spark, sf).select("image_id", "cand_id", "score", "x1", "y1", "w", "h"), scratch(spark, "images")
    write_images(d.where("image_id % 3 = 0").withColumn("written", F.lit(1)), at)
    whole = d.withColumn("written", F.lit(2))
    write_images(whole, at)
    return read_images(spark, at, whole.schema)
