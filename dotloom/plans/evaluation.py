"""Registered queries of evaluation: bins and totals, caches against annotations, classes, detection; and their SQL checks."""

from pyspark.sql import functions as F

from dotloom.functions import tables
from dotloom.functions.scalars import cache_name, stem
from dotloom.operators import detection as E
from dotloom.operators import dots as D
from dotloom.operators import masks as M
from dotloom.operators import rle
from dotloom.operators import scoring as V
from dotloom.plans.registry import BIN, MATCH, ORACLE, _inputs, count_oracle_rows, match_candidates
from dotloom.plans.scoring import BASE, _linear, _means, _scored, _vectors
from dotloom.sources import cache as C
from dotloom.sources import derived as S
from dotloom.sources.store import scratch
from dotloom.streaming.recall import follow_recall, latest_recall

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name, sql):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


def _cov(where: str = "true") -> str:
    return f"count(*) FILTER (WHERE EXISTS (SELECT 1 FROM cand_run c WHERE c.image_id=d.image_id AND c.y=d.yi AND d.xi>=c.xs AND d.xi<c.xe AND {where}))"


@_add("dot_recall_table", S.SQL + f"""per AS (SELECT image_id, count(*) AS dots, {_cov()} AS cov FROM dot d GROUP BY 1), b AS (SELECT *, {BIN} AS bin FROM per),
g AS (SELECT bin, count(*) AS images, sum(dots) AS dots, sum(cov) AS cov, avg(cov/CAST(dots AS DOUBLE)) AS macro FROM b GROUP BY 1 UNION ALL SELECT 'ALL', count(*), sum(dots), sum(cov), avg(cov/CAST(dots AS DOUBLE)) FROM b HAVING count(*)>0),
n AS (SELECT * FROM (VALUES (0,'0-10'),(1,'11-20'),(2,'21-50'),(3,'51-100'),(4,'100+'),(5,'ALL')) v(place, bin))
SELECT CAST(place AS INTEGER) AS place, bin, coalesce(images,0) AS images, CAST(coalesce(dots,0) AS BIGINT) AS dots, round(cov/CAST(dots AS DOUBLE),6) AS micro, round(macro,6) AS macro FROM n LEFT JOIN g USING (bin)""")
def dot_recall_table(spark, sf):
    """Bins and ALL in one pass; bins without images keep their row."""
    _, runs, dots = _inputs(spark, sf)
    return D.recall_table(D.recall_rows(dots, runs))


@_add("count_oracle_by_bin", ORACLE + f"""SELECT {BIN.replace('dots', 'gt')} AS bin, count(*) AS images, round(avg(abs(pred_cover-gt)),6) AS cover_mae, round(avg(abs(pred_greedy-gt)),6) AS greedy_mae, round(sqrt(avg((pred_cover-gt)*(pred_cover-gt))),6) AS cover_rmse,
round(sqrt(avg((pred_greedy-gt)*(pred_greedy-gt))),6) AS greedy_rmse, round(avg(pred_cover/CAST(gt AS DOUBLE)),6) AS recall FROM rw GROUP BY 1""")
def count_oracle_by_bin(spark, sf):
    return D.oracle_by_bin(count_oracle_rows(spark, sf))


def _versus(spark, sf):
    """The old cache has a third of the candidates, and lacks every fourth image."""
    _, runs, dots = _inputs(spark, sf)
    old = runs.where("cand_id % 3 = 0 AND image_id % 4 <> 1")
    return D.versus(D.recall_rows(dots, runs), D.recall_rows(dots.where("image_id % 4 <> 1"), old))


VERSUS = S.SQL + f"vs AS (SELECT image_id, count(*) AS dots, {_cov()} AS cov, CASE WHEN image_id%4<>1 THEN count(*) END AS old_dots, CASE WHEN image_id%4<>1 THEN {_cov('c.cand_id%3=0')} END AS old_cov FROM dot d GROUP BY 1)"


@_add("new_vs_old_recall", VERSUS + "SELECT image_id, dots, cov, old_dots, old_cov, round(cov/CAST(dots AS DOUBLE),4) AS new_recall, round(old_cov/CAST(old_dots AS DOUBLE),4) AS old_recall FROM vs")
def new_vs_old_recall(spark, sf):
    return _versus(spark, sf)


@_add("new_vs_old_total", VERSUS + "SELECT count(*) AS images, count(old_dots) AS old_images, round(sum(cov)/CAST(sum(dots) AS DOUBLE),6) AS micro_new, round(sum(old_cov)/CAST(sum(old_dots) AS DOUBLE),6) AS micro_old FROM vs")
def new_vs_old_total(spark, sf):
    return D.versus_total(_versus(spark, sf))


RAW = "rd AS (SELECT CAST(floor(sqrt(event_id/CAST(2 AS DOUBLE))) AS BIGINT) AS image_id, event_id AS dot_id FROM events WHERE event_id%3<>0)"


@_add("scan_outcomes", S.SQL + RAW + """, oc AS (SELECT image_id, CASE WHEN image_id NOT IN (SELECT image_id FROM rd) THEN 'no_annotation' WHEN image_id NOT IN (SELECT image_id FROM dot WHERE xi<20 AND yi<20) THEN 'no_dot_in_image' ELSE 'done' END AS outcome FROM (SELECT DISTINCT image_id FROM cand))
SELECT outcome, count(*) AS n FROM oc GROUP BY 1""")
def scan_outcomes(spark, sf):
    """Cached images joined with annotations: how many are done, and why others are skipped."""
    c, _, dots = _inputs(spark, sf)
    points = S.dots(spark, sf).where("dot_id % 3 <> 0")
    return D.scan_outcome(c, points, dots.where("xi < 20 AND yi < 20")).groupBy("outcome").agg(F.count("*").alias("n"))


def _vocabulary(spark):
    """Ten classes, of which those divisible by three aren't countable; class 8 has no entry."""
    return spark.range(10).where("id <> 8").selectExpr("id AS class_idx", "concat('class_', id) AS name", "id % 3 <> 0 AS is_countable")


@_add("countable_labels", MATCH + "SELECT cand_id, CAST(CASE WHEN valid>0 AND matched_class%3<>0 AND matched_class<>8 AND matched_class<10 THEN 1 ELSE 0 END AS DOUBLE) AS is_countable, greatest(matched_class, 0) AS export_class, purity*valid AS weight FROM m")
def countable_labels(spark, sf):
    m = match_candidates(spark, sf)
    return V.countable(m, _vocabulary(spark)).select("cand_id", "is_countable", F.col("export_class").cast("long").alias("export_class"), (F.col("purity") * F.col("valid")).alias("weight"))


@_add("dominant_class_name", MATCH + """, c AS (SELECT image_id, matched_class, count(*) AS n, min(cand_id) AS f FROM m WHERE valid=1 GROUP BY 1,2), d AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, f) AS r FROM c)
SELECT i.image_id, CASE WHEN d.matched_class IS NULL THEN '__background__' WHEN d.matched_class=8 OR d.matched_class>=10 THEN '__unknown__' ELSE 'class_' || d.matched_class END AS class_name FROM (SELECT DISTINCT image_id FROM cand) i LEFT JOIN d ON d.image_id=i.image_id AND r=1""")
def dominant_class_name(spark, sf):
    from dotloom.plans.scoring import dominant_class

    return V.class_names(dominant_class(spark, sf), _vocabulary(spark)).select("image_id", "class_name")


AUX = "(SELECT cand_id, sum(v*((k-1)%5-2))*0.5+0.1 AS logit FROM (SELECT cand_id, unnest(z) AS v, unnest(generate_series(1, 64)) AS k FROM e) GROUP BY 1)"


@_add("fold_evaluation", BASE + f"""tp AS (SELECT cand_id, class_idx FROM (SELECT cand_id, class_idx, row_number() OVER (PARTITION BY cand_id ORDER BY {{A}}*(cs/0.07)+(1-{{A}})*cl DESC, class_idx) AS r FROM sc) WHERE r=1),
j AS (SELECT m.cand_id%3 AS fold, m.valid, tp.class_idx=m.matched_class AS hit, (x.logit>0) = (m.valid>0 AND m.matched_class%3<>0 AND m.matched_class<>8 AND m.matched_class<10) AS same FROM tp JOIN m USING (cand_id) JOIN {AUX} x USING (cand_id))
SELECT fold, count(*) FILTER (WHERE valid>0) AS n_valid, round(count(*) FILTER (WHERE valid>0 AND hit)/CAST(greatest(count(*) FILTER (WHERE valid>0),1) AS DOUBLE),6) AS top1, round(count(*) FILTER (WHERE valid>0 AND same)/CAST(greatest(count(*) FILTER (WHERE valid>0),1) AS DOUBLE),6) AS countable_acc FROM j GROUP BY 1""".replace("{A}", "(1/(1+exp(CAST(-0.4 AS DOUBLE))))"))
def fold_evaluation(spark, sf):
    """Top-1 and countable accuracy of the hybrid and auxiliary heads over valid candidates, by fold."""
    m = V.countable(match_candidates(spark, sf), _vocabulary(spark)).select("cand_id", "matched_class", "valid", "is_countable")
    aux = V.auxiliary(V.with_head(_scored(spark, sf), "hybrid"), [0.5 * (k % 5 - 2) for k in range(64)], 0.1)
    return V.evaluation(aux.join(m, "cand_id").withColumn("fold", F.col("cand_id") % 3), "logit", "fold")


@_add("expanded_logits", BASE + "x AS (SELECT cand_id, class_idx, list_inner_product(z, mu) AS d FROM e, pr WHERE cand_id%5<>0) SELECT cand_id, class_idx, round(CASE WHEN class_idx<7 THEN 8*d-0.1*(class_idx%3) WHEN class_idx<9 THEN 2*d+0.5 ELSE 0 END,4) AS closed FROM x")
def expanded_logits(spark, sf):
    """Linear scores after the head was given rows for the classes 7 and 8."""
    means = _means(spark, sf)
    new = means.where("class_idx < 9").select("class_idx", F.transform("mu", lambda x: x * 2).alias("w"), F.lit(0.5).alias("b"))
    s = V.head_scores(_vectors(spark, sf).where("cand_id % 5 <> 0"), means, V.expand_classes(_linear(means), new))
    return V.with_head(s, "linear").select("cand_id", F.explode("scores").alias("s")).select("cand_id", "s.class_idx", F.round("s.logit", 4).alias("closed"))


@_add("epoch_losses", BASE + """b AS (SELECT s.cand_id%3 AS epoch, CAST(floor(s.cand_id/64.0) AS BIGINT) AS batch, any_value(m.purity)*any_value(m.valid) AS w, ln(sum(exp(cs/0.1)))-max(cs/0.1) FILTER (WHERE class_idx=label) AS ce, max(cs) FILTER (WHERE class_idx=label) AS x FROM sc s JOIN m ON m.cand_id=s.cand_id GROUP BY s.cand_id),
g AS (SELECT epoch, batch, sum(w*ce)/greatest(sum(w),1e-6) AS ce, sum(w*(greatest(x,0)-x+ln(1+exp(-abs(x)))))/greatest(sum(w),1e-6) AS bce FROM b WHERE x IS NOT NULL GROUP BY 1,2)
SELECT epoch, count(*) AS batches, round(avg(ce),6) AS ce, round(avg(bce),6) AS bce FROM g GROUP BY 1""")
def epoch_losses(spark, sf):
    """Mean losses of an epoch over its batches."""
    w = match_candidates(spark, sf).select("cand_id", (F.col("purity") * F.col("valid")).alias("w"))
    r = _scored(spark, sf).join(w, "cand_id").select((F.col("cand_id") % 3).alias("epoch"), F.floor(F.col("cand_id") / 64).alias("batch"), "w", V.cross_entropy("cosine", "label", 0.1).alias("ce"), V.at_class("cosine", "label").alias("x"))
    r = r.where("x IS NOT NULL").withColumn("bce", V.bce(F.col("x"), F.lit(1.0)))
    return V.epoch_means(r.groupBy("epoch", "batch").agg(V.weighted_mean("ce", "w").alias("ce"), V.weighted_mean("bce", "w").alias("bce")), "ce", "bce")


@_add("rle_roundtrip", S.SQL + """px AS (SELECT image_id, cand_id, y, unnest(generate_series(xs, xe-1)) AS x FROM cand_run), f AS (SELECT * FROM px WHERE x<64 AND y<64 AND image_id%7<>0)
SELECT cand_id, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x)+1 AS x2, max(y)+1 AS y2, CAST(sum(x*y) AS BIGINT) AS moment FROM f GROUP BY 1""")
def rle_roundtrip(spark, sf):
    """Masks written in the run-length code and read again; masks of another size than their image's are left out."""
    c, runs, _ = _inputs(spark, sf)
    sizes = c.select("image_id").distinct().select("image_id", F.lit(S.SIDE).alias("height"), F.lit(S.SIDE).alias("width"))
    image = sizes.withColumn("width", F.when(F.col("image_id") % 7 == 0, 32).otherwise(F.col("width")))
    got = rle.decode(rle.encode(runs, sizes, "image_id", "cand_id").join(image, "image_id"), "cand_id")
    one = "aggregate(sequence(xs, xe-1), 0L, (a, x) -> a + x * y)"
    return got.groupBy("cand_id").agg(F.sum(F.col("xe") - F.col("xs")).alias("area"), F.min("xs").alias("x1"), F.min("y").alias("y1"), F.max("xe").alias("x2"), (F.max("y") + 1).alias("y2"), F.expr(f"sum({one}) AS moment"))


@_add("mask_runs_sql", S.SQL + """px AS (SELECT DISTINCT image_id, cand_id, y, unnest(generate_series(xs, xe-1)) AS x FROM cand_run), f AS (SELECT * FROM px WHERE x<64 AND y<64)
SELECT image_id, y, count(DISTINCT cand_id) AS masks, count(*) AS pixels, min(x) AS first_x, max(x)+1 AS end_x FROM f GROUP BY 1,2""")
def mask_runs_sql(spark, sf):
    """Compressed masks read by the table function: pixels of each row of an image."""
    c, runs, _ = _inputs(spark, sf)
    tables.register(spark)
    sizes = c.select("image_id").distinct().select("image_id", F.lit(S.SIDE).alias("height"), F.lit(S.SIDE).alias("width"))
    masks = rle.encode(runs, sizes, "image_id", "cand_id")
    sql = "SELECT image_id, y, count(DISTINCT cand_id) AS masks, sum(xe - xs) AS pixels, min(xs) AS first_x, max(xe) AS end_x FROM mask_runs(TABLE({masks})) GROUP BY image_id, y"
    return spark.sql(sql, masks=masks)


@_add("cache_entries", BASE + "y AS (SELECT m.image_id, lpad(CAST(m.image_id AS VARCHAR), 12, '0') AS name, count(*) AS n, list(greatest(m.matched_class, 0) ORDER BY m.cand_id) AS matched_class, list(m.valid ORDER BY m.cand_id) AS valid, list(m.purity ORDER BY m.cand_id) AS purity FROM m GROUP BY 1) SELECT image_id, name, n, CAST(matched_class AS VARCHAR) AS matched_class, CAST(valid AS VARCHAR) AS valid, CAST(sum_ AS DOUBLE) AS purity FROM (SELECT *, round(list_sum(purity), 4) AS sum_ FROM y)")
def cache_entries(spark, sf):
    """One entry an image, its candidates' fields as arrays in the order of their ids."""
    m = match_candidates(spark, sf).withColumn("matched_class", F.greatest("matched_class", F.lit(0)))
    e = C.entries(m, "cand_id", "matched_class", "valid", "purity").select("image_id", cache_name().alias("name"), F.size("cand_id").cast("long").alias("n"), "matched_class", "valid", "purity")
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return e.select("image_id", "name", "n", text("matched_class").alias("matched_class"), text("valid").alias("valid"), F.round(F.aggregate("purity", F.lit(0.0), lambda a, x: a + x), 4).alias("purity"))


@_add("limited_files", """WITH f AS (SELECT DISTINCT CAST(floor(vec_id/12.0) AS BIGINT) AS image_id FROM embeddings), n AS (SELECT 'cache_' || (image_id%3) AS directory, CASE WHEN image_id%11=0 THEN 'text_prototypes' ELSE 'im' || image_id END AS stem FROM f)
SELECT directory, stem || '.pt' AS file, stem FROM (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY stem) AS r FROM (SELECT DISTINCT * FROM n WHERE stem<>'text_prototypes')) WHERE r<=5""")
def limited_files(spark, sf):
    """The first five cache files of each directory by name, without the prototypes' file."""
    i = S.candidates(spark, sf).select("image_id").distinct()
    f = i.select(F.format_string("cache_%d", F.col("image_id") % 3).alias("directory"), F.when(F.col("image_id") % 11 == 0, "text_prototypes.pt").otherwise(F.format_string("im%d.pt", "image_id")).alias("file")).distinct()
    return C.first_files(f, 5).select("directory", "file", stem("file").alias("stem"))


DETECT = MATCH.replace("WITH ", "WITH RECURSIVE ", 1) + """, tr AS (SELECT image_id, gt_id, label, x1, y1, w, h FROM gt),
bi AS (SELECT c.image_id, c.cand_id, t.gt_id, greatest(0,least(c.x1+c.w,t.x1+t.w)-greatest(c.x1,t.x1))*greatest(0,least(c.y1+c.h,t.y1+t.h)-greatest(c.y1,t.y1)) AS i, c.w*c.h+t.w*t.h AS s FROM cand c JOIN tr t ON c.image_id=t.image_id AND c.label%3=t.label%3),
ol AS ({OVER}),
op AS (SELECT image_id, cand_id, list(gt_id ORDER BY iou DESC, gt_id) AS options FROM ol WHERE iou>=0.4 GROUP BY 1,2),
pr AS (SELECT c.image_id, c.label%3 AS class_idx, c.cand_id, score, coalesce(options, []) AS options, row_number() OVER (PARTITION BY c.image_id, c.label%3 ORDER BY score DESC, c.cand_id) AS n FROM cand c LEFT JOIN op ON op.cand_id=c.cand_id),
wl AS (SELECT image_id, class_idx, n, cand_id, score, options, options[1] AS gt_id, options[1:1] AS used FROM pr WHERE n=1 UNION ALL
 SELECT p.image_id, p.class_idx, p.n, p.cand_id, p.score, p.options, list_filter(p.options, lambda g: NOT list_contains(w.used, g))[1], list_concat(w.used, list_filter(p.options, lambda g: NOT list_contains(w.used, g))[1:1]) FROM wl w JOIN pr p ON p.image_id=w.image_id AND p.class_idx=w.class_idx AND p.n=w.n+1)
"""
BOXES = "SELECT image_id, cand_id, gt_id, i/CAST(s-i AS DOUBLE) AS iou FROM bi WHERE i>0"
MASKS = "SELECT it.image_id, it.cand_id, it.gt_id, it.i/CAST(ca.a+ga.g-it.i AS DOUBLE) AS iou FROM it JOIN ca USING (cand_id) JOIN ga USING (gt_id) JOIN cand c ON c.cand_id=it.cand_id JOIN tr ON tr.gt_id=it.gt_id AND tr.label%3=c.label%3"
AP = """st AS (SELECT class_idx, score AS s, count(gt_id) AS tp, count(*) AS n FROM wl GROUP BY 1,2), ru AS (SELECT *, sum(tp) OVER w AS t, sum(n) OVER w AS k FROM st WINDOW w AS (PARTITION BY class_idx ORDER BY s DESC)),
gg AS (SELECT label%3 AS class_idx, count(*) AS truths FROM tr GROUP BY 1)
SELECT gg.class_idx, truths, round(coalesce(sum(tp*t/CAST(k AS DOUBLE)),0)/truths,10) AS ap, round(coalesce(sum(tp),0)/CAST(truths AS DOUBLE),10) AS recall FROM gg LEFT JOIN ru USING (class_idx) GROUP BY 1,2"""


def _detections(spark, sf, masks):
    """Predictions and truths by class (label modulo 3), and their matching by box or mask."""
    c = S.candidates(spark, sf)
    t = S.truths(c)
    preds = c.select("image_id", (F.col("label") % 3).alias("class_idx"), "cand_id", "score")
    truths = t.select("image_id", "gt_id", (F.col("label") % 3).alias("class_idx"))
    if masks:
        o = M.mask_overlaps(S.candidate_runs(c), S.truth_runs(t), "cand_id", "gt_id").select("image_id", "cand_id", "gt_id", "iou")
    else:
        box = F.struct("x1", "y1", "w", "h")
        o = c.select("image_id", "cand_id", box.alias("a")).join(t.select("image_id", "gt_id", box.alias("b")), "image_id").select("image_id", "cand_id", "gt_id", M.box_iou("a", "b").alias("iou")).where("iou > 0")
    same = o.join(preds.select("cand_id", "class_idx"), "cand_id").join(truths.select("gt_id", F.col("class_idx").alias("g")), "gt_id").where("class_idx = g").select("image_id", "cand_id", "gt_id", "iou")
    return E.matched(preds, same, 0.4), truths


@_add("box_average_precision", DETECT.replace("{OVER}", BOXES) + "," + AP)
def box_average_precision(spark, sf):
    return E.precision_recall(*_detections(spark, sf, False))


@_add("mask_average_precision", DETECT.replace("{OVER}", MASKS) + "," + AP)
def mask_average_precision(spark, sf):
    return E.precision_recall(*_detections(spark, sf, True))


@_add("detection_errors", DETECT.replace("{OVER}", MASKS) + """SELECT count(*) AS n, (SELECT count(*) FROM tr) AS truths, round(avg(CASE WHEN gt_id IS NULL AND len(options)>0 THEN 1 ELSE 0 END),6) AS duplicate_rate, round(avg(CASE WHEN gt_id IS NULL THEN 1 ELSE 0 END),6) AS false_positive_rate,
 round(avg(CASE WHEN gt_id IS NOT NULL AND cand_id IN (SELECT cand_id FROM m WHERE label_type='part') THEN 1 ELSE 0 END),6) AS part_as_instance_rate, round(((SELECT count(*) FROM tr)-count(gt_id))/CAST((SELECT count(*) FROM tr) AS DOUBLE),6) AS false_negative_rate FROM wl""")
def detection_errors(spark, sf):
    rows, truths = _detections(spark, sf, True)
    return E.error_rates(rows, truths, match_candidates(spark, sf).where("label_type = 'part'"))


@_add("streamed_recall", S.SQL + f"per AS (SELECT image_id, count(*) AS dots, {_cov()} AS cov FROM dot d GROUP BY 1) SELECT image_id, dots, CAST(cov AS BIGINT) AS cov FROM per")
def streamed_recall(spark, sf):
    """Candidates and dots arrive in three parts; the query is started anew for each and goes on with its states."""
    _, runs, dots = _inputs(spark, sf)
    at = scratch(spark, "stream")
    for part in range(3):
        for name, d, key in (("runs", runs, "cand_id"), ("dots", dots, "dot_id")):
            d.where(F.pmod(F.xxhash64(key), F.lit(3)) == part).write.mode("append").parquet(f"{at}/{name}")
        follow_recall(*[spark.readStream.schema(d.schema).parquet(f"{at}/{name}") for name, d in (("dots", dots), ("runs", runs))], f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return latest_recall(spark, f"{at}/out")
