"""Registered queries of scoring, losses, pairs and class counts, and their independent SQL checks."""

from pyspark.sql import functions as F

from dotloom.operators import geometry as G
from dotloom.operators import masks as M
from dotloom.operators import scoring as V
from dotloom.operators import vocabulary as B
from dotloom.plans.registry import MATCH, match_candidates
from dotloom.sources import derived as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name, sql):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


#: Prototypes come from every fifth vector; the others are scored. The linear head knows the classes below 7.
BASE = MATCH + """, e AS (SELECT vec_id AS cand_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
mn AS (SELECT label AS class_idx, k, avg(v/n) AS v FROM (SELECT label, sqrt(list_inner_product(z, z)) AS n, unnest(generate_series(1, 64)) AS k, unnest(z) AS v FROM e WHERE cand_id%5=0) GROUP BY 1,2),
pr AS (SELECT class_idx, list(v ORDER BY k) AS mu, sqrt(sum(v*v)) AS nm FROM mn GROUP BY 1),
sc AS (SELECT cand_id, label, class_idx, list_inner_product(z, mu)/(nm*sqrt(list_inner_product(z, z))) AS cs, CASE WHEN class_idx<7 THEN 8*list_inner_product(z, mu)-0.1*(class_idx%3) ELSE 0 END AS cl FROM e, pr WHERE cand_id%5<>0),
"""
#: Sigmoid of the hybrid head's raw 0.4.
ALPHA = "(1/(1+exp(CAST(-0.4 AS DOUBLE))))"


def _vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("cand_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("z"))


def _means(spark, sf):
    return V.class_means(_vectors(spark, sf).where("cand_id % 5 = 0"))


def _linear(means, below=7):
    return means.where(F.col("class_idx") < below).select("class_idx", F.transform("mu", lambda x: x * 8).alias("w"), F.expr("-0.1D*(class_idx%3)").alias("b"))


def _scored(spark, sf):
    means = _means(spark, sf)
    return V.head_scores(_vectors(spark, sf).where("cand_id % 5 <> 0"), means, _linear(means), raw_alpha=0.4)


def _targets(spark, sf):
    m = match_candidates(spark, sf).where("valid > 0").select("cand_id", F.col("matched_class").alias("target"), F.col("purity").alias("w"))
    return _scored(spark, sf).join(m, "cand_id")


@_add("class_prototypes", BASE + "y AS (SELECT 1) SELECT class_idx, CAST(k-1 AS BIGINT) AS pos, round(v/nm,6) AS v FROM mn JOIN pr USING (class_idx)")
def class_prototypes(spark, sf):
    p = _means(spark, sf).select("class_idx", F.posexplode("unit").alias("pos", "v"))
    return p.select("class_idx", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


@_add("head_logits", BASE + "y AS (SELECT 1) SELECT cand_id, class_idx, round(cs/0.07,4) AS open, round(cl,4) AS closed, round({A}*(cs/0.07)+(1-{A})*cl,4) AS hybrid FROM sc".replace("{A}", ALPHA))
def head_logits(spark, sf):
    s = _scored(spark, sf).select("cand_id", F.explode("scores").alias("s"))
    return s.select("cand_id", "s.class_idx", *[F.round(f"s.{c}", 4).alias(c) for c in ("open", "closed", "hybrid")])


@_add("class_top5", BASE + "y AS (SELECT cand_id, class_idx, row_number() OVER (PARTITION BY cand_id ORDER BY cs DESC, class_idx)-1 AS rank FROM sc) SELECT * FROM y WHERE rank<5")
def class_top5(spark, sf):
    return V.top_classes(_scored(spark, sf), "open")


@_add("head_branches", BASE + f"""br AS (SELECT 'open' AS branch, cand_id, class_idx, cs/0.07 AS x FROM sc UNION ALL SELECT 'closed', cand_id, class_idx, cl FROM sc UNION ALL SELECT 'hybrid', cand_id, class_idx, {ALPHA}*(cs/0.07)+(1-{ALPHA})*cl FROM sc),
ev AS (SELECT b.branch, b.cand_id, CASE WHEN any_value(g.x) IS NOT NULL THEN count(*) FILTER (WHERE b.x>g.x) END AS rk, any_value(m.purity) AS w FROM br b JOIN m ON m.cand_id=b.cand_id AND m.valid=1 LEFT JOIN br g ON g.branch=b.branch AND g.cand_id=b.cand_id AND g.class_idx=m.matched_class GROUP BY 1,2)
SELECT branch, count(*) AS n, round(avg(CASE WHEN rk=0 THEN 1 ELSE 0 END),6) AS top1, round(avg(CASE WHEN rk<5 THEN 1 ELSE 0 END),6) AS top5, round(sum(CASE WHEN rk=0 THEN w ELSE 0 END)/greatest(sum(w),1e-9),4) AS weighted_top1,
 round(coalesce(avg(CASE WHEN rk=0 THEN 1 ELSE 0 END) FILTER (WHERE w>0.7), 0),6) AS high_purity_top1, round(avg(rk),6) AS mean_rank FROM ev GROUP BY 1""")
def head_branches(spark, sf):
    return V.accuracy(_targets(spark, sf), "target", "w", "open", "closed", "hybrid")


@_add("margin_logits", BASE + """y AS (SELECT cand_id, class_idx, class_idx=label AS t, least(greatest(cs,-0.999999),0.999999) AS c FROM sc)
SELECT cand_id, class_idx, round(30*CASE WHEN t THEN cos(acos(c)+0.5) ELSE c END,4) AS arc, round(30*CASE WHEN t THEN c-0.35 ELSE c END,4) AS cosine FROM y""")
def margin_logits(spark, sf):
    s = _scored(spark, sf).select("cand_id", "label", F.explode("scores").alias("s"))
    at, c = F.col("s.class_idx") == F.col("label"), F.col("s.cosine")
    return s.select("cand_id", "s.class_idx", F.round(V.margin_logit(c, at, "arc", 0.5, 30.0), 4).alias("arc"), F.round(V.margin_logit(c, at, "cos", 0.35, 30.0), 4).alias("cosine"))


@_add("training_losses", BASE + """ct AS (SELECT count(*) AS nc FROM pr), y0 AS (SELECT s.cand_id, any_value(m.purity) AS w, any_value(m.matched_class) AS t, ln(sum(exp(cs/0.1))) AS l, sum(0.5+0.25*(class_idx%4)) AS ws, sum((0.5+0.25*(class_idx%4))*cs/0.1) AS wx,
 max(cs) FILTER (WHERE class_idx=m.matched_class) AS x, ln(sum(exp(cs/0.07)))-max(cs/0.07) FILTER (WHERE class_idx=m.matched_class) AS al FROM sc s JOIN m ON m.cand_id=s.cand_id AND m.valid=1 GROUP BY 1),
y AS (SELECT *, 0.5+0.25*(t%4) AS wt, l-x/0.1 AS ce FROM y0 WHERE x IS NOT NULL),
v AS (SELECT *, 0.9*wt*ce+0.1*(ws*l-wx)/nc AS sm, wt*power(1-exp(-ce),2)*ce AS fo, greatest(x,0)-x*(CASE WHEN t<5 THEN 1 ELSE 0 END)+ln(1+exp(-abs(x))) AS bc FROM y, ct),
g AS (SELECT sum(w*ce)/sum(w) AS ce, sum(w*sm)/sum(w) AS sm, sum(w*fo)/sum(w) AS fo, sum(w*bc)/sum(w) AS bc, sum(w*al)/sum(w) AS al FROM v)
SELECT round(ce,6) AS ce, round(sm,6) AS smoothed, round(fo,6) AS focal, round(bc,6) AS bce, round(al,6) AS align, round(sm+0.5*bc+0.1*al,6) AS total FROM g""")
def training_losses(spark, sf):
    """Cross entropy plain and with smoothing and class weights, weighted focal loss, BCE, alignment and their total."""
    weights = _means(spark, sf).agg(F.map_from_entries(F.collect_list(F.struct("class_idx", F.expr("0.5D+0.25D*(class_idx%4)").alias("x")))).alias("cw"))  # one row
    r = _targets(spark, sf).crossJoin(F.broadcast(weights)).withColumn("x", V.at_class("cosine", "target")).where("x IS NOT NULL")
    r = r.select(
        "w", "x", V.cross_entropy("cosine", "target", 0.1).alias("ce"), V.cross_entropy("cosine", "target", 0.1, 0.1, "cw").alias("smoothed"), V.cross_entropy("cosine", "target", 0.07).alias("align"),
        F.try_element_at("cw", F.col("target")).alias("wt"), (F.col("target") < 5).cast("double").alias("y"),
    )
    r = r.withColumn("focal", V.focal(F.col("ce"), weight=F.col("wt"))).withColumn("bce", V.bce(F.col("x"), F.col("y")))
    parts = ("ce", "smoothed", "focal", "bce", "align")
    g = r.agg(*[V.weighted_mean(c, "w").alias(c) for c in parts])
    return g.withColumn("total", V.total_loss(F.col("smoothed"), F.col("bce"), F.col("align"), lambda_align=0.1)).select(*[F.round(c, 6).alias(c) for c in (*parts, "total")])


@_add("learning_rates", "SELECT epoch, round(CASE WHEN epoch<5 THEN (epoch+1)/5.0 ELSE 0.5*(1+cos(pi()*(epoch-5)/35.0)) END,6) AS factor FROM (SELECT unnest(generate_series(0, 39)) AS epoch)")
def learning_rates(spark, sf):
    return V.learning_rates(spark, 40, 5).withColumn("factor", F.round("factor", 6))


@_add("early_stop", """WITH m AS (SELECT CAST(floor(vec_id/20.0) AS BIGINT) AS run, vec_id%20 AS epoch, (vec_id*37)%101 AS metric FROM embeddings),
i AS (SELECT *, NOT EXISTS (SELECT 1 FROM m p WHERE p.run=m.run AND p.epoch<m.epoch AND p.metric>=m.metric) AS improved FROM m),
s AS (SELECT *, epoch-(SELECT max(q.epoch) FROM i q WHERE q.run=i.run AND q.epoch<=i.epoch AND q.improved) AS since FROM i)
SELECT run, epoch, metric, improved FROM s WHERE NOT EXISTS (SELECT 1 FROM s q WHERE q.run=s.run AND q.epoch<s.epoch AND q.since>=6)""")
def early_stop(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("CAST(floor(vec_id/20) AS BIGINT) AS run", "vec_id%20 AS epoch", "(vec_id*37)%101 AS metric")
    return V.early_stop(e, 6)


@_add("dominant_class", MATCH + """, c AS (SELECT image_id, matched_class, count(*) AS n, min(cand_id) AS f FROM m WHERE valid=1 GROUP BY 1,2)
SELECT i.image_id, coalesce(d.matched_class, -1) AS class_idx, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT image_id FROM cand) i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, f) AS r FROM c) d ON d.image_id=i.image_id AND r=1""")
def dominant_class(spark, sf):
    """Most frequent class of an image's valid candidates, the first seen among equals; -1 without any."""
    m = match_candidates(spark, sf)
    n = m.groupBy("image_id", "matched_class").agg(F.count_if(F.col("valid") > 0).alias("n"), F.min(F.when(F.col("valid") > 0, F.col("cand_id"))).alias("f"))
    best = n.groupBy("image_id").agg(F.max_by(F.struct("matched_class", "n"), F.when(F.col("n") > 0, F.struct("n", -F.col("f")))).alias("b"))
    return best.select("image_id", F.coalesce("b.matched_class", F.lit(-1)).cast("long").alias("class_idx"), F.coalesce("b.n", F.lit(0)).cast("long").alias("n"))


@_add("class_count_errors", MATCH + """, g AS (SELECT image_id, label AS c, count(*) AS gt FROM gt GROUP BY 1,2), p AS (SELECT image_id, matched_class AS c, count(*) AS pred FROM m WHERE valid=1 GROUP BY 1,2),
j AS (SELECT coalesce(g.c,p.c) AS class_idx, CAST(coalesce(gt,0) AS DOUBLE) AS gt, coalesce(pred,0)-coalesce(gt,0) AS e FROM g FULL JOIN p ON g.image_id=p.image_id AND g.c=p.c)
SELECT class_idx, count(*) AS n, round(avg(abs(e)),6) AS mae, round(sqrt(avg(e*e)),6) AS rmse, round(avg(abs(e)/gt) FILTER (WHERE gt>0),6) AS nae, round(sqrt(avg(e*e/gt) FILTER (WHERE gt>0)),6) AS sre FROM j GROUP BY 1""")
def class_count_errors(spark, sf):
    g = S.truths(S.candidates(spark, sf)).groupBy("image_id", F.col("label").alias("class_idx")).agg(F.count("*").alias("gt"))
    p = match_candidates(spark, sf).where("valid > 0").groupBy("image_id", F.col("matched_class").alias("class_idx")).agg(F.count("*").alias("pred"))
    j = g.join(p, ["image_id", "class_idx"], "full").fillna(0, ["gt", "pred"]).withColumn("e", (F.col("pred") - F.col("gt")).cast("double"))
    return j.groupBy("class_idx").agg(F.count("*").alias("n"), F.expr("round(avg(abs(e)),6) AS mae"), F.expr("round(sqrt(avg(e*e)),6) AS rmse"), F.expr("round(avg(try_divide(abs(e),gt)),6) AS nae"), F.expr("round(sqrt(avg(try_divide(e*e,gt))),6) AS sre"))


@_add("pair_features", BASE + """mi AS (SELECT c.cand_id AS i, d.cand_id AS j, sum(least(c.xe,d.xe)-greatest(c.xs,d.xs)) AS n FROM cand_run c JOIN cand_run d ON c.image_id=d.image_id AND c.y=d.y AND c.cand_id<d.cand_id AND c.xs<d.xe AND d.xs<c.xe GROUP BY 1,2),
p AS (SELECT c.cand_id AS i, d.cand_id AS j, x.a, y.a AS b, coalesce(n,0) AS n, list_cosine_similarity(ei.z, ej.z) AS cs, sqrt(power(c.x1+c.w/2.0-d.x1-d.w/2.0,2)+power(c.y1+c.h/2.0-d.y1-d.h/2.0,2)) AS dist,
 u.valid*v.valid AS ok, u.matched_class=v.matched_class AS sc, u.matched_instance_id=v.matched_instance_id AS si, u.coverage AS ci, v.coverage AS cj
 FROM cand c JOIN cand d ON c.image_id=d.image_id AND c.cand_id<d.cand_id JOIN ca x ON x.cand_id=c.cand_id JOIN ca y ON y.cand_id=d.cand_id JOIN e ei ON ei.cand_id=c.cand_id JOIN e ej ON ej.cand_id=d.cand_id
 JOIN m u ON u.cand_id=c.cand_id JOIN m v ON v.cand_id=d.cand_id LEFT JOIN mi ON mi.i=c.cand_id AND mi.j=d.cand_id)
SELECT i, j, round(cs,6) AS cosine, round(n/CAST(a+b-n AS DOUBLE),6) AS mask_iou, round(n/CAST(a AS DOUBLE),6) AS inside_i, round(n/CAST(b AS DOUBLE),6) AS inside_j, round(dist/64,6) AS distance, round(least(a,b)/CAST(greatest(a,b) AS DOUBLE),6) AS area_ratio,
 ok=1 AND sc AS y_sem, ok=1 AND si AS y_inst, round(CASE WHEN ok=1 AND si THEN n/CAST(a AS DOUBLE)*greatest(0,cj-ci) ELSE 0 END,4) AS y_part FROM p""")
def pair_features(spark, sf):
    """Features and labels of the pairs i < j of an image; overlaps come from the run join, absent ones are 0."""
    c = S.candidates(spark, sf)
    runs = S.candidate_runs(c)
    m = match_candidates(spark, sf).select("cand_id", "valid", "matched_class", "matched_instance_id", "coverage")
    row = c.join(M.areas(runs, "cand_id", "a"), ["image_id", "cand_id"]).join(m, "cand_id").join(_vectors(spark, sf).select("cand_id", "z"), "cand_id")
    row = row.select("image_id", "cand_id", F.struct("a", "valid", "matched_class", "matched_instance_id", "coverage", "z", F.expr("x1+w/2D").alias("cx"), F.expr("y1+h/2D").alias("cy")).alias("s"))
    i, j = row.withColumnsRenamed({"cand_id": "i", "s": "u"}), row.withColumnsRenamed({"cand_id": "j", "s": "v"})
    a = runs.withColumnRenamed("cand_id", "i_id")
    n = M.intersections(a, runs.withColumnRenamed("cand_id", "j_id")).where("i_id < j_id").select("image_id", F.col("i_id").alias("i"), F.col("j_id").alias("j"), F.col("inter").alias("n"))
    p = i.join(j, "image_id").where("i < j").join(n, ["image_id", "i", "j"], "left").fillna(0, ["n"])
    ok, inst = "u.valid * v.valid = 1", "u.matched_instance_id = v.matched_instance_id"
    return p.select(
        "i", "j", F.round(V.dot(F.col("u.z"), F.col("v.z")) / (V.norm(F.col("u.z")) * V.norm(F.col("v.z"))), 6).alias("cosine"), F.expr("round(n/(u.a+v.a-n),6) AS mask_iou"), F.expr("round(n/u.a,6) AS inside_i"), F.expr("round(n/v.a,6) AS inside_j"),
        F.expr("round(sqrt(power(u.cx-v.cx,2)+power(u.cy-v.cy,2))/64,6) AS distance"), F.expr("round(least(u.a,v.a)/greatest(u.a,v.a),6) AS area_ratio"),
        F.expr(f"{ok} AND u.matched_class = v.matched_class AS y_sem"), F.expr(f"{ok} AND {inst} AS y_inst"), F.expr(f"round(CASE WHEN {ok} AND {inst} THEN n/u.a*greatest(0,v.coverage-u.coverage) ELSE 0D END,4) AS y_part"),
    )


#: The five prompt templates.
TEMPLATES = ("a photo of a {}.", "a close-up photo of a {}.", "a photo of a single {}.", "an image of a {}.", "a cropped photo of a {}.")


@_add("prompt_texts", "SELECT DISTINCT p_type AS name, CAST(i AS BIGINT) AS template, replace(t, '{}', p_type) AS prompt FROM part, (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(TEMPLATES)) + ") v(i, t)")
def prompt_texts(spark, sf):
    """Every template of a templates table with every class name."""
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_type").alias("name")).distinct()
    table = spark.createDataFrame(list(enumerate(TEMPLATES)), "template long, text string")
    return names.crossJoin(F.broadcast(table)).select("name", "template", F.replace(F.col("text"), F.lit("{}"), F.col("name")).alias("prompt"))


@_add("seed_points", """WITH s AS (SELECT unnest(generate_series(0, 47)) AS k), l AS (SELECT unnest(generate_series(0, 1)) AS layer)
SELECT layer, a.k*48+b.k AS point_id, round((b.k+0.5)*8/384,6) AS x, round((a.k+0.5)*8/384,6) AS y FROM s a, s b, l""")
def seed_points(spark, sf):
    """Cell centres at a spacing of 8 of 384 pixels, for the whole image and one crop layer."""
    return G.seed_grid(spark, 8, 384, 1).select("layer", "point_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


#: Every fifth vector is a class of its own, so that classes grow with the table; the others are scored, each true to the class before it.
OPEN = """WITH e AS (SELECT vec_id AS cand_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
cl AS (SELECT cand_id AS class_idx, z AS mu, sqrt(list_inner_product(z, z)) AS nm FROM e WHERE cand_id%5=0),
sc AS (SELECT cand_id, cand_id-cand_id%5 AS target, class_idx, {A}*(list_inner_product(z, mu)/(nm*sqrt(list_inner_product(z, z)))/0.07)+(1-{A})*CASE WHEN class_idx%3<>0 THEN 8*list_inner_product(z, mu)-0.1*(class_idx%3) ELSE 0 END AS x FROM e, cl WHERE cand_id%5<>0),
ow AS (SELECT cand_id, x AS own FROM sc WHERE class_idx=target), mx AS (SELECT cand_id, max(x) AS top FROM sc GROUP BY 1),
""".replace("{A}", ALPHA)


def _open(spark, sf):
    e = _vectors(spark, sf)
    means = e.where("cand_id % 5 = 0").select(F.col("cand_id").alias("class_idx"), F.col("z").alias("mu"), V.normalised(F.col("z")).alias("unit"))
    linear = means.where("class_idx % 3 <> 0").select("class_idx", F.transform("mu", lambda x: x * 8).alias("w"), F.expr("-0.1D*(class_idx%3)").alias("b"))
    vectors = e.where("cand_id % 5 <> 0").select("cand_id", "z", F.expr("cand_id - cand_id % 5").alias("target"))
    return B.vocabulary_scores(vectors, means, linear, "hybrid", "target", raw_alpha=0.4)


@_add("vocabulary_losses", OPEN + """lo AS (SELECT cand_id, any_value(own) AS own, any_value(top) + ln(sum(exp(x-top))) AS lse, count(*) AS n, sum(x) AS s, count(*) FILTER (WHERE x>own) AS rank FROM sc JOIN mx USING (cand_id) LEFT JOIN ow USING (cand_id) GROUP BY 1)
SELECT cand_id, CASE WHEN own IS NOT NULL THEN rank END AS rank, n AS n_classes, round(lse,4) AS log_sum, round((lse-own)*0.9+(lse-s/n)*0.1,4) AS loss FROM lo""")
def vocabulary_losses(spark, sf):
    """Rank of the true class and smoothed loss over a vocabulary of any size."""
    d = B.vocabulary_loss(_open(spark, sf), "target", smoothing=0.1)
    return d.select("cand_id", "rank", "n_classes", F.round("log_sum", 4).alias("log_sum"), F.round("loss", 4).alias("loss"))


@_add("vocabulary_top5", OPEN + "y AS (SELECT cand_id, class_idx, x, row_number() OVER (PARTITION BY cand_id ORDER BY x DESC, class_idx)-1 AS rank FROM sc) SELECT cand_id, rank, class_idx, round(x,4) AS score FROM y WHERE rank<5")
def vocabulary_top5(spark, sf):
    d = _open(spark, sf).select("cand_id", F.posexplode("top").alias("rank", "t"))
    return d.select("cand_id", F.col("rank").cast("long").alias("rank"), "t.class_idx", F.round("t.score", 4).alias("score"))
