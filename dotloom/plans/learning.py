"""Registered queries of training, and their independent SQL checks."""

import numpy as np
from pyspark.sql import functions as F

from dotloom.operators import training as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: A linear head over the region vector itself: nine epochs of one step, two of them warm-up.
CONFIG = T.Config(head="linear", layers=0, epochs=9, lr=0.05, weight_decay=0.01, warmup=2, smoothing=0.1, lambda_count=0.5, lambda_align=0.0)

#: The same in SQL, a row for each weight and epoch; class -1 is the auxiliary output, place 65 the bias.
SQL = """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS y, list_append(CAST(embedding AS DOUBLE[]), CAST(1 AS DOUBLE)) AS z, CASE WHEN vec_id%7<>0 THEN (1+vec_id%4)/4.0 ELSE 0 END AS w, CASE WHEN label%2=0 THEN 1 ELSE 0 END AS t, vec_id%5=0 AS held FROM embeddings),
n AS (SELECT max(y)+1 AS c FROM v), tr AS MATERIALIZED (SELECT * FROM v WHERE NOT held AND w>0), sw AS (SELECT sum(w) AS s FROM tr),
it AS (SELECT 0 AS e, c, k, CASE WHEN k=65 THEN 0 ELSE ((c*31+k*17+40)%23-11)/CAST(50 AS DOUBLE) END AS p, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS lc, CAST(0 AS DOUBLE) AS lb FROM (SELECT unnest(generate_series(-1, (SELECT c-1 FROM n))) AS c) CROSS JOIN (SELECT unnest(generate_series(1, 65)) AS k)),
st AS (SELECT * FROM it UNION ALL (
 WITH l AS (SELECT e, c, list(p ORDER BY k) AS pv FROM st WHERE e<9 GROUP BY 1,2),
 x AS (SELECT l.e, l.c, tr.id, tr.y, tr.w, tr.t, tr.z, list_inner_product(tr.z, l.pv) AS x FROM tr, l),
 s AS (SELECT id, ln(sum(exp(x))) AS lse, sum(x) AS sx FROM x WHERE c>=0 GROUP BY 1),
 d AS (SELECT x.e, x.c, x.z, x.w, CASE WHEN x.c<0 THEN 0.5*(1/(1+exp(-x.x))-x.t) ELSE exp(x.x-s.lse)-0.9*(CASE WHEN x.c=x.y THEN 1 ELSE 0 END)-0.1/n.c END AS d,
  CASE WHEN x.c=x.y THEN 0.9*(s.lse-x.x) ELSE 0 END + CASE WHEN x.c=0 THEN 0.1*(s.lse-s.sx/n.c) ELSE 0 END AS lc, CASE WHEN x.c<0 THEN greatest(x.x, 0)-x.x*x.t+ln(1+exp(-abs(x.x))) ELSE 0 END AS lb FROM x JOIN s USING (id), n),
 lo AS (SELECT sum(w*lc) AS lc, sum(w*lb) AS lb FROM d),
 g AS (SELECT e, c, k, sum(w*d*u)/any_value(s) AS g FROM (SELECT e, c, w, d, unnest(z) AS u, unnest(generate_series(1, 65)) AS k FROM d), sw GROUP BY 1,2,3),
 h AS (SELECT st.e+1 AS e, st.c, st.k, st.p, 0.9*st.m+0.1*g.g AS m, 0.999*st.q+0.001*g.g*g.g AS q, lo.lc/sw.s AS lc, lo.lb/sw.s AS lb, 0.05*CASE WHEN st.e<2 THEN (st.e+1)/2.0 ELSE 0.5*(1+cos(pi()*(st.e-2)/7.0)) END AS lr FROM st JOIN g ON st.e=g.e AND st.c=g.c AND st.k=g.k, lo, sw)
 SELECT e, c, k, p*(1-lr*0.01)-lr*(m/(1-power(0.9, e)))/(sqrt(q/(1-power(0.999, e)))+1e-8), m, q, lc, lb FROM h)),
ev AS (SELECT e, id, y, t, arg_max(c, x) FILTER (WHERE c>=0) AS best, max(x) FILTER (WHERE c<0)>0 AS ct FROM (SELECT st.e, st.c, v.id, v.y, v.t, sum(st.p*z[k]) AS x FROM v, st WHERE held AND vec_id_valid(id) AND e>0 GROUP BY ALL) GROUP BY ALL),
ac AS (SELECT e, avg(CASE WHEN best=y THEN 1 ELSE 0 END) AS top1, avg(CASE WHEN ct=(t=1) THEN 1 ELSE 0 END) AS ca, count(*) AS nv FROM ev GROUP BY 1),
hi AS (SELECT e, any_value(lc) AS lc, any_value(lb) AS lb FROM st WHERE e>0 GROUP BY 1),
be AS (SELECT min(e) AS e FROM ac WHERE top1=(SELECT max(top1) FROM ac))
""".replace("vec_id_valid(id)", "id%7<>0")


def _rows(spark, sf):
    """Vectors with weights, and whether a row is held out for validation."""
    d = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("cand_id"), F.col("label").cast("long").alias("matched_class"), F.col("embedding").cast("array<double>").alias("z"))
    return d.withColumns({"purity": F.expr("(1 + cand_id % 4) / 4D"), "valid": F.expr("CAST(cand_id % 7 <> 0 AS INT)"), "is_countable": F.expr("CAST(matched_class % 2 = 0 AS DOUBLE)"), "held": F.expr("cand_id % 5 = 0")})


def _first_weights(classes: int, dim: int) -> dict:
    grid = lambda rows: ((rows[:, None] * 31 + np.arange(1, dim + 1) * 17 + 40) % 23 - 11) / 50.0
    return {"classifier.weight": grid(np.arange(classes)), "classifier.bias": np.zeros(classes), "aux.is_countable.weight": grid(np.array([-1])), "aux.is_countable.bias": np.zeros(1)}


def _trained(spark, sf):
    rows = _rows(spark, sf)
    n = rows.agg(F.max("matched_class").alias("c"), F.max(F.size("z")).alias("d")).first()
    return T.train(rows.where("NOT held"), np.eye(n.c + 1, n.d), CONFIG, rows.where("held"), weights=_first_weights(n.c + 1, n.d))


def trained_head(spark, sf):
    """Weights of the best epoch of a linear head trained on ``embeddings``; place 65 is the bias."""
    t = _trained(spark, sf).linear_table(spark)
    w = t.select("class_idx", F.posexplode(F.concat("w", F.array("b"))).alias("pos", "v"))
    return w.select("class_idx", (F.col("pos") + 1).cast("long").alias("pos"), F.round("v", 6).alias("v"))


def training_history(spark, sf):
    """Losses and validation of each epoch of that training."""
    h = _trained(spark, sf).history_table(spark)
    return h.select("epoch", *[F.round(c, 6).alias(c) for c in ("lr", "L_cls", "L_count", "L_total", "eval_top1", "eval_countable_acc")], F.col("eval_n_valid").cast("long").alias("n_valid"), "best")


QUERIES["trained_head"], ORACLE_SQL["trained_head"] = trained_head, SQL + "SELECT c AS class_idx, k AS pos, round(p, 6) AS v FROM st JOIN be USING (e) WHERE c>=0"
QUERIES["training_history"] = training_history
ORACLE_SQL["training_history"] = SQL + """SELECT e AS epoch, round(0.05*CASE WHEN e<=2 THEN e/2.0 ELSE 0.5*(1+cos(pi()*(e-3)/7.0)) END, 6) AS lr, round(lc, 6) AS L_cls, round(lb, 6) AS L_count, round(lc+0.5*lb, 6) AS L_total,
round(top1, 6) AS eval_top1, round(ca, 6) AS eval_countable_acc, nv AS n_valid, NOT EXISTS (SELECT 1 FROM ac p WHERE p.e<ac.e AND p.top1>=ac.top1) AS best FROM hi JOIN ac USING (e)"""
