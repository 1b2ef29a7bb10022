"""Registered queries of the counting operators and their independent SQL checks."""

from pyspark.sql import functions as F

from dotloom.operators import dots as D
from dotloom.operators import geometry as G
from dotloom.operators import masks as M
from dotloom.operators import splits as P
from dotloom.sources import derived as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name, sql):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


def _inputs(spark, sf):
    c = S.candidates(spark, sf)
    return c, S.candidate_runs(c), D.in_bounds(S.dots(spark, sf), S.SIDE)


BIN = "CASE WHEN dots<=10 THEN '0-10' WHEN dots<=20 THEN '11-20' WHEN dots<=50 THEN '21-50' WHEN dots<=100 THEN '51-100' ELSE '100+' END"


def _recall_sql(bin_: str, r: int) -> str:
    return S.SQL + f"""per AS (SELECT d.image_id, count(*) AS dots, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM cand_run c WHERE c.image_id=d.image_id AND abs(c.y-d.yi)<={r} AND d.xi>=c.xs-{r} AND d.xi<c.xe+{r})) AS cov FROM dot d GROUP BY 1)
SELECT {bin_} AS bin, count(*) AS images, CAST(sum(dots) AS BIGINT) AS dots, round(sum(cov)/CAST(sum(dots) AS DOUBLE),6) AS micro, round(avg(cov/CAST(dots AS DOUBLE)),6) AS macro FROM per GROUP BY 1"""


def _recall(name, total, radius):
    @_add(name, _recall_sql("'ALL'" if total else BIN, radius))
    def run(spark, sf):
        _, runs, dots = _inputs(spark, sf)
        return D.recall_by_bin(D.recall_rows(dots, runs, radius), total)


_recall("dot_recall_by_bin", False, 0)
_recall("dot_recall_total", True, 0)
_recall("dot_recall_dilated", False, 2)

MATCH = S.SQL + """ca AS (SELECT cand_id, sum(xe-xs) AS a FROM cand_run GROUP BY 1), ga AS (SELECT gt_id, sum(xe-xs) AS g FROM gt_run GROUP BY 1),
it AS (SELECT c.image_id, c.cand_id, t.gt_id, sum(least(c.xe,t.xe)-greatest(c.xs,t.xs)) AS i FROM cand_run c JOIN gt_run t ON c.image_id=t.image_id AND c.y=t.y AND c.xs<t.xe AND t.xs<c.xe GROUP BY 1,2,3),
ov AS (SELECT it.image_id, it.cand_id, it.gt_id, i/CAST(a+g-i AS DOUBLE) AS iou, i/CAST(a AS DOUBLE) AS purity, i/CAST(g AS DOUBLE) AS coverage, max(i/CAST(a AS DOUBLE)) OVER (PARTITION BY it.cand_id) AS mp,
 row_number() OVER (PARTITION BY it.cand_id ORDER BY i/CAST(a+g-i AS DOUBLE) DESC, it.gt_id) AS r FROM it JOIN ca USING (cand_id) JOIN ga USING (gt_id)),
m AS (SELECT c.image_id, c.cand_id, round(coalesce(iou,0),6) AS iou, round(coalesce(purity,0),6) AS purity, round(coalesce(coverage,0),6) AS coverage,
 CASE WHEN mp>=0.5 THEN gt.label ELSE -1 END AS matched_class, CASE WHEN mp>=0.5 THEN o.gt_id ELSE -1 END AS matched_instance_id, CAST(CASE WHEN mp>=0.5 THEN 1 ELSE 0 END AS BIGINT) AS valid,
 CASE WHEN mp IS NULL OR mp<0.5 THEN 'background' WHEN coverage<0.5 AND purity>=0.5 THEN 'part' ELSE 'valid' END AS label_type
 FROM cand c LEFT JOIN (SELECT * FROM ov WHERE r=1) o ON c.cand_id=o.cand_id LEFT JOIN gt ON gt.gt_id=o.gt_id)
"""


def _matched(spark, sf):
    c, runs, _ = _inputs(spark, sf)
    g = S.truths(c)
    return M.match(c, runs, g, S.truth_runs(g))


@_add("match_candidates", MATCH + "SELECT * FROM m")
def match_candidates(spark, sf):
    return _matched(spark, sf).withColumns({c: F.round(c, 6) for c in ("iou", "purity", "coverage")})


@_add("match_label_counts", MATCH + "SELECT label_type, count(*) AS n FROM m GROUP BY 1")
def match_label_counts(spark, sf):
    return _matched(spark, sf).groupBy("label_type").agg(F.count("*").alias("n"))


@_add("class_weights", MATCH + """, f AS (SELECT l.label, greatest(count(m.cand_id),1) AS n FROM (SELECT DISTINCT label FROM cand) l LEFT JOIN m ON m.matched_class=l.label AND m.valid>0 GROUP BY 1),
w AS (SELECT label, n, sum(n) OVER ()/CAST(count(*) OVER () * n AS DOUBLE) AS w FROM f) SELECT label, n, round(w/avg(w) OVER (),6) AS weight FROM w""")
def class_weights(spark, sf):
    """Inverse-frequency class weights with mean 1; a class without valid candidates counts once."""
    n = _matched(spark, sf).where("valid > 0").groupBy(F.col("matched_class").alias("label")).agg(F.count("*").alias("k"))
    f = S.candidates(spark, sf).select("label").distinct().join(n, "label", "left").select("label", F.greatest(F.coalesce("k", F.lit(0)), F.lit(1)).cast("long").alias("n"))
    t = f.agg(F.sum("n").alias("s"), F.count("*").alias("c"), F.sum(1 / F.col("n")).alias("h"))  # one row
    w = F.col("s") / (F.col("c") * F.col("n"))
    return f.crossJoin(F.broadcast(t)).select("label", "n", F.round(w / (F.col("s") / F.col("c") * F.col("h") / F.col("c")), 6).alias("weight"))


AREAS = "ca AS (SELECT cand_id, sum(xe-xs) AS a FROM cand_run GROUP BY 1),"


def _dup_sql(some: str) -> str:
    """Near-duplicate suppression walked candidate by candidate, over the candidates that ``some`` keeps."""
    return S.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + AREAS + f"""cs AS (SELECT c.* FROM cand c JOIN ca USING (cand_id) WHERE {some}),
mi AS (SELECT c.cand_id AS p, d.cand_id AS q, sum(least(c.xe,d.xe)-greatest(c.xs,d.xs)) AS i FROM cand_run c JOIN cand_run d ON c.image_id=d.image_id AND c.y=d.y AND c.cand_id<>d.cand_id AND c.xs<d.xe AND d.xs<c.xe GROUP BY 1,2),
bx AS (SELECT c.cand_id AS p, d.cand_id AS q, greatest(0,least(c.x1+c.w,d.x1+d.w)-greatest(c.x1,d.x1))*greatest(0,least(c.y1+c.h,d.y1+d.h)-greatest(c.y1,d.y1)) AS i, c.w*c.h+d.w*d.h AS t FROM cs c JOIN cs d ON c.image_id=d.image_id AND c.cand_id<>d.cand_id),
du AS (SELECT mi.p, list(mi.q) AS dups FROM mi JOIN ca x ON x.cand_id=mi.p JOIN ca y ON y.cand_id=mi.q JOIN bx ON bx.p=mi.p AND bx.q=mi.q WHERE mi.i/CAST(x.a+y.a-mi.i AS DOUBLE)>0.9 AND bx.i/CAST(bx.t-bx.i AS DOUBLE)>0.5 GROUP BY 1),
o AS (SELECT c.image_id, c.cand_id, coalesce(dups, []) AS dups, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, c.cand_id) AS n FROM cs c LEFT JOIN du ON du.p=c.cand_id),
wk AS (SELECT image_id, n, [cand_id] AS kept FROM o WHERE n=1 UNION ALL SELECT o.image_id, o.n, CASE WHEN list_has_any(kept, dups) THEN kept ELSE list_append(kept, o.cand_id) END FROM wk JOIN o ON o.image_id=wk.image_id AND o.n=wk.n+1)
"""


DUP = _dup_sql("true")


@_add("near_dup_suppressed", DUP + "SELECT image_id, unnest(kept) AS cand_id FROM (SELECT image_id, arg_max(kept, n) AS kept FROM wk GROUP BY 1)")
def near_dup_suppressed(spark, sf):
    c, runs, _ = _inputs(spark, sf)
    return M.suppress(c, runs)


@_add("capped_candidates", DUP + "SELECT image_id, unnest(kept[1:5]) AS cand_id FROM (SELECT image_id, arg_max(kept, n) AS kept FROM wk GROUP BY 1)")
def capped_candidates(spark, sf):
    c, runs, _ = _inputs(spark, sf)
    return M.suppress(c, runs, 5)


SIZED = "a/4096.0 BETWEEN 0.055 AND 0.11 AND w>=15 AND h>=15 AND score>=0.25"


@_add("filter_candidates", _dup_sql(SIZED) + "SELECT image_id, unnest(kept[1:4]) AS cand_id FROM (SELECT image_id, arg_max(kept, n) AS kept FROM wk GROUP BY 1)")
def filter_candidates(spark, sf):
    c, runs, _ = _inputs(spark, sf)
    return M.filter_candidates(c, runs, S.SIDE, S.SIDE, cap=4, lo=0.055, hi=0.11, least=15, min_score=0.25)


@_add("sized_candidates", S.SQL + AREAS + f"z AS (SELECT 1) SELECT image_id, cand_id, w, h FROM cand JOIN ca USING (cand_id) WHERE {SIZED}")
def sized_candidates(spark, sf):
    c, runs, _ = _inputs(spark, sf)
    return M.sized(c, runs, S.SIDE, S.SIDE, 0.055, 0.11, 15, 0.25).select("image_id", "cand_id", "w", "h")


@_add("top_by_predicted_iou", S.SQL + """z AS (SELECT image_id, cand_id, row_number() OVER (PARTITION BY image_id ORDER BY (cand_id*17)%7 DESC, cand_id) AS r FROM cand)
SELECT image_id, cand_id FROM z WHERE r<=3""")
def top_by_predicted_iou(spark, sf):
    c = S.candidates(spark, sf).withColumn("predicted_iou", F.expr("((cand_id*17)%7)/7D"))
    return M.top_by(c, "predicted_iou", 3).select("image_id", "cand_id")


#: Boxes of a canvas's candidates moved and grown, so that some leave the image and some have no width.
def _wild_boxes(spark, sf):
    c = S.candidates(spark, sf).withColumns({"width": F.lit(S.SIDE), "height": F.lit(S.SIDE)})
    e = {"x1": "x1*2.25D-30.5D", "y1": "y1*2.25D-30.5D", "x2": "x1*2.25D-30.5D+(w-16)*2.75D", "y2": "y1*2.25D-30.5D+(h-16)*2.75D"}
    return c.select("image_id", "cand_id", "width", "height", *[F.expr(v).alias(k) for k, v in e.items()])


WILD = "wd AS (SELECT image_id, cand_id, x1*d-30.5 AS x1, y1*d-30.5 AS y1, x1*d-30.5+(w-16)*g AS x2, y1*d-30.5+(h-16)*g AS y2 FROM cand, (SELECT CAST(2.25 AS DOUBLE) AS d, CAST(2.75 AS DOUBLE) AS g)),"


def _clip(x1, y1, x2, y2, more="", name="cl", src="wd"):
    lo = lambda v: f"greatest(0, least(CAST(trunc({v}) AS BIGINT), 63))"
    hi = lambda v, w: f"greatest({w}+1, least(CAST(trunc({v}) AS BIGINT), 64))"
    return f"{name}0 AS (SELECT *, {lo(x1)} AS p, {lo(y1)} AS q FROM {src}), {name} AS (SELECT image_id, cand_id{more}, p AS u1, q AS v1, {hi(x2, 'p')} AS u2, {hi(y2, 'q')} AS v2 FROM {name}0),"


CROPS = WILD + _clip("x1", "y1", "x2", "y2") + "ex AS (SELECT image_id, cand_id, u1 AS bx1, v1 AS by1, u2 AS bx2, v2 AS by2, u1-CAST(trunc((u2-u1)*0.5) AS BIGINT) AS x1, v1-CAST(trunc((v2-v1)*0.5) AS BIGINT) AS y1, u2+CAST(trunc((u2-u1)*0.5) AS BIGINT) AS x2, v2+CAST(trunc((v2-v1)*0.5) AS BIGINT) AS y2 FROM cl)," + _clip("x1", "y1", "x2", "y2", ", bx1, by1, bx2, by2", "cx", "ex")


@_add("crop_boxes", S.SQL + CROPS + "z AS (SELECT 1) SELECT cand_id, bx1 AS x1, by1 AS y1, bx2 AS x2, by2 AS y2, u1 AS cx1, v1 AS cy1, u2 AS cx2, v2 AS cy2 FROM cx")
def crop_boxes(spark, sf):
    """Clipped boxes and their context, of boxes that leave the image."""
    return G.context_boxes(_wild_boxes(spark, sf)).select("cand_id", *G.BOX, "cx1", "cy1", "cx2", "cy2")


@_add("masked_crops", S.SQL + CROPS + """px AS (SELECT cand_id, y, unnest(generate_series(xs, xe-1)) AS x FROM cand_run)
SELECT cand_id, count(*) AS area, min(x)-any_value(bx1) AS left_x, max(y)-any_value(by1) AS low_y FROM px JOIN cx USING (cand_id) WHERE x>=bx1 AND x<bx2 AND y>=by1 AND y<by2 GROUP BY 1""")
def masked_crops(spark, sf):
    """Area and corner of each mask inside its clipped box, in the box's coordinates."""
    _, runs, _ = _inputs(spark, sf)
    r = G.masked_crop(runs, G.clipped(_wild_boxes(spark, sf)), "image_id", "cand_id")
    return r.groupBy("cand_id").agg(F.sum(F.col("xe") - F.col("xs")).alias("area"), F.min("xs").alias("left_x"), F.max("y").alias("low_y"))


PIXEL = "(x*7+y*13+image_id*31)%256"


@_add("crop_pixels", S.SQL + CROPS + f"""bx AS (SELECT cand_id, image_id, 'box' AS view, bx1 AS l, by1 AS t, bx2 AS r, by2 AS b FROM cx UNION ALL SELECT cand_id, image_id, 'context', u1, v1, u2, v2 FROM cx),
ys AS (SELECT *, unnest(generate_series(t, b-1)) AS y FROM bx), xy AS (SELECT *, unnest(generate_series(l, r-1)) AS x FROM ys),
mk AS (SELECT cand_id, image_id, y, unnest(generate_series(xs, xe-1)) AS x FROM cand_run),
ms AS (SELECT cx.cand_id, sum({PIXEL.replace('image_id', 'cx.image_id')}) AS s FROM cx JOIN mk ON mk.cand_id=cx.cand_id AND x>=bx1 AND x<bx2 AND y>=by1 AND y<by2 GROUP BY 1)
SELECT cand_id, view, r-l AS width, b-t AS height, CAST(sum({PIXEL}) AS BIGINT) AS total FROM xy GROUP BY cand_id, view, l, t, r, b
UNION ALL SELECT cand_id, 'masked', bx2-bx1, by2-by1, CAST(coalesce(s, 0) AS BIGINT) FROM cx LEFT JOIN ms USING (cand_id)""")
def crop_pixels(spark, sf):
    """Size and sum of the first channel of the three crops of each candidate, from images with a known pixel rule."""
    c, runs, _ = _inputs(spark, sf)
    side = S.SIDE
    pixel = F.expr(f"transform(sequence(0, {side * side - 1}), k -> CAST(((k%{side})*7+CAST(floor(k/{side}) AS BIGINT)*13+image_id*31)%256 AS INT))")
    rgb = F.unhex(F.concat_ws("", F.transform(pixel, lambda v: F.concat(F.lpad(F.hex(v), 2, "0"), F.lit("0000")))))
    images = c.select("image_id").distinct().select("image_id", F.lit(side).alias("height"), F.lit(side).alias("width"), rgb.alias("rgb"))
    m = runs.groupBy("image_id", "cand_id").agg(F.collect_list(F.struct("y", "xs", "xe")).alias("runs"))
    got = G.pixel_crops(images, G.context_boxes(_wild_boxes(spark, sf)).join(m, ["image_id", "cand_id"]))
    first = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda k: F.conv(F.hex(F.substring("rgb", k * 3 + 1, F.lit(1))), 16, 10).cast("long"))
    return got.select("cand_id", "view", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.aggregate(first, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@_add("geometry_features", S.SQL + """a AS (SELECT cand_id, sum(xe-xs) AS a FROM cand_run GROUP BY 1), b AS (SELECT cand_id, a, x1, y1, x1+w-16 AS x2, y1+h-16 AS y2, greatest(w-16, 1) AS bw, greatest(h-16, 1) AS bh FROM cand JOIN a USING (cand_id))
SELECT cand_id, round((x1+x2)/2.0/64,6) AS cx, round((y1+y2)/2.0/64,6) AS cy, round(bw/64.0,6) AS nw, round(bh/64.0,6) AS nh, round(bw*bh/4096.0,6) AS box_ratio, round(a/4096.0,6) AS mask_ratio, round(bw/CAST(bh AS DOUBLE),6) AS aspect, round(a/CAST(bw*bh AS DOUBLE),6) AS fill FROM b""")
def geometry_features(spark, sf):
    """Features of narrow boxes, some without width."""
    c, runs, _ = _inputs(spark, sf)
    boxes = c.withColumns({"x2": F.expr("x1+w-16"), "y2": F.expr("y1+h-16"), "width": F.lit(S.SIDE), "height": F.lit(S.SIDE)})
    d = G.geometry_features(boxes.join(M.areas(runs, "cand_id", "area"), ["image_id", "cand_id"]))
    return d.select("cand_id", *[F.round(k, 6).alias(k) for k in ("cx", "cy", "nw", "nh", "box_ratio", "mask_ratio", "aspect", "fill")])


@_add("mask_to_bbox", S.SQL + "z AS (SELECT 1) SELECT cand_id, min(xs) AS x1, min(y) AS y1, max(xe) AS x2, max(y)+1 AS y2 FROM cand_run GROUP BY 1")
def mask_to_bbox(spark, sf):
    _, runs, _ = _inputs(spark, sf)
    return runs.groupBy("cand_id").agg(F.min("xs").alias("x1"), F.min("y").alias("y1"), F.max("xe").alias("x2"), (F.max("y") + 1).alias("y2"))


@_add("mask_union_area", S.SQL + "px AS (SELECT DISTINCT image_id, y, unnest(generate_series(xs, xe-1)) AS x FROM cand_run) SELECT image_id, count(*) AS area FROM px GROUP BY 1")
def mask_union_area(spark, sf):
    _, runs, _ = _inputs(spark, sf)
    return M.union_runs(runs).groupBy("image_id").agg(F.sum(F.col("xe") - F.col("xs")).alias("area"))


@_add("count_errors_by_order", """WITH r AS (SELECT l_orderkey, count(*) AS gt, count(*) FILTER (WHERE l_discount<0.08) AS pred FROM lineitem GROUP BY 1)
SELECT CASE WHEN gt<=2 THEN 'few' ELSE 'many' END AS bin, count(*) AS n, round(avg(abs(pred-gt)),6) AS mae, round(sqrt(avg((pred-gt)*(pred-gt))),6) AS rmse, round(avg(pred-gt),6) AS bias FROM r GROUP BY 1""")
def count_errors_by_order(spark, sf):
    r = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("gt"), F.count_if(F.col("l_discount") < 0.08).alias("pred"))
    return D.errors(r.withColumn("bin", F.when(F.col("gt") <= 2, "few").otherwise("many")), "gt", "pred", "bin")


ORACLE = S.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """hit AS (SELECT DISTINCT d.image_id, c.cand_id, d.dot_id FROM dot d JOIN cand_run c ON c.image_id=d.image_id AND c.y=d.yi AND d.xi>=c.xs AND d.xi<c.xe),
st AS (SELECT image_id, cand_id, list(dot_id) AS s FROM hit GROUP BY 1,2),
im AS (SELECT image_id, list(s ORDER BY cand_id) AS sets, list_distinct(flatten(list(s))) AS rem FROM st GROUP BY 1),
wk AS (SELECT image_id, sets, rem, CAST(0 AS BIGINT) AS n FROM im UNION ALL
 SELECT image_id, sets, list_filter(rem, lambda v: NOT list_contains(sets[list_position(g, list_max(g))], v)), n+1 FROM (SELECT *, list_transform(sets, lambda t: len(list_intersect(t, rem))) AS g FROM wk WHERE len(rem)>0)),
rw AS (SELECT image_id, count(*) AS gt, CAST(coalesce(max(c), 0) AS BIGINT) AS pred_cover, coalesce(max(n), 0) AS pred_greedy FROM dot LEFT JOIN (SELECT image_id, max(len(rem)) AS c, max(n) AS n FROM wk GROUP BY 1) USING (image_id) GROUP BY 1)
"""


@_add("count_oracle_rows", ORACLE + "SELECT * FROM rw")
def count_oracle_rows(spark, sf):
    _, runs, dots = _inputs(spark, sf)
    return D.count_oracle(dots, runs)


@_add("count_oracle_overall", ORACLE + "SELECT count(*) AS n, round(avg(abs(pred_greedy-gt)),6) AS mae, round(sqrt(avg((pred_greedy-gt)*(pred_greedy-gt))),6) AS rmse, round(avg(pred_greedy-gt),6) AS bias FROM rw")
def count_oracle_overall(spark, sf):
    return D.errors(count_oracle_rows(spark, sf), "gt", "pred_greedy")


def _split_sql(keys: str, ratio: float) -> str:
    """max(1, trunc(n * ratio)) keys by the seeded hash, from ``keys`` (k)."""
    return f"""k0 AS ({keys}), kh AS (SELECT k, (((k%2147483647)*48271+69621)%2147483647)*16807%2147483647 AS h FROM k0),
kv AS (SELECT k, row_number() OVER (ORDER BY h, k) <= greatest(1, CAST(trunc((SELECT count(*) FROM k0)*CAST({ratio} AS DOUBLE)) AS BIGINT)) AS val FROM kh)"""


@_add("split_by_image", "WITH " + _split_sql("SELECT DISTINCT CAST(floor(vec_id/12.0) AS BIGINT) AS k FROM embeddings", 0.1) + "SELECT k AS image_id, CASE WHEN val THEN 'val' ELSE 'train' END AS part FROM kv")
def split_by_image(spark, sf):
    train, val = P.split(S.candidates(spark, sf).select("image_id").distinct(), "image_id", 0.1)
    return train.withColumn("part", F.lit("train")).union(val.withColumn("part", F.lit("val")))


@_add("class_split", "WITH " + _split_sql("SELECT DISTINCT CAST(label AS BIGINT) AS k FROM embeddings", 0.3) + "SELECT CAST(vec_id AS BIGINT) AS cand_id, CASE WHEN val THEN 'held_out' ELSE 'train' END AS part FROM embeddings JOIN kv ON k=label")
def class_split(spark, sf):
    """All candidates of a held-out class stay together: semi and anti join."""
    train, held = P.split(S.candidates(spark, sf).select("cand_id", "label"), "label", 0.3)
    return train.select("cand_id", F.lit("train").alias("part")).union(held.select("cand_id", F.lit("held_out").alias("part")))


@_add("held_out_classes", "WITH " + _split_sql("SELECT DISTINCT CAST(label AS BIGINT) AS k FROM embeddings", 0.3) + "SELECT k AS label FROM kv WHERE val")
def held_out_classes(spark, sf):
    """The held-out classes, in order."""
    return P.validation_keys(S.candidates(spark, sf), "label", 0.3).orderBy("label")


#: Sizes of their own: no two sides alike, some images without pixels.
SIZES = "sz AS (SELECT image_id, CASE WHEN image_id%17=16 THEN 0 ELSE 24+(image_id*7)%50 END AS height, 20+(image_id*13)%90 AS width FROM (SELECT DISTINCT image_id FROM cand)),"


def _sizes(spark, sf):
    i = S.candidates(spark, sf).select("image_id").distinct()
    return i.selectExpr("image_id", "CASE WHEN image_id%17=16 THEN 0 ELSE 24+(image_id*7)%50 END AS height", "20+(image_id*13)%90 AS width")


RAW = "rd AS (SELECT CAST(floor(sqrt(event_id/CAST(2 AS DOUBLE))) AS BIGINT) AS image_id, event_id AS dot_id, CAST(round_even(value*0.5,0) AS BIGINT) AS xi, CAST(round_even((event_id%131)*0.5,0) AS BIGINT) AS yi FROM events), ds AS (SELECT rd.* FROM rd JOIN sz USING (image_id) WHERE xi>=0 AND xi<width AND yi>=0 AND yi<height)"


@_add("image_dot_recall", S.SQL + SIZES + RAW + "SELECT d.image_id, count(*) AS dots, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM cand_run c WHERE c.image_id=d.image_id AND c.y=d.yi AND d.xi>=c.xs AND d.xi<c.xe)) AS cov FROM ds d GROUP BY 1")
def image_dot_recall(spark, sf):
    """Dots and covered dots of images of unequal, oblong sizes."""
    c = S.candidates(spark, sf)
    return D.recall_rows(D.in_bounds(S.dots(spark, sf), _sizes(spark, sf)), S.candidate_runs(c))


@_add("image_candidates", S.SQL + SIZES + AREAS + "z AS (SELECT 1) SELECT c.image_id, cand_id, height, width FROM cand c JOIN ca USING (cand_id) JOIN sz ON sz.image_id=c.image_id WHERE height>0 AND a/CAST(height*width AS DOUBLE) BETWEEN 0.05 AND 0.3 AND w>=15 AND h>=15 AND score>=0.1")
def image_candidates(spark, sf):
    """Candidates whose mask has a fitting share of their own image."""
    c = S.candidates(spark, sf)
    return M.sized(c.join(_sizes(spark, sf), "image_id"), S.candidate_runs(c), "height", "width", 0.05, 0.3, 15, 0.1).select("image_id", "cand_id", "height", "width")
