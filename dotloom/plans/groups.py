"""Registered queries of pairs and counting groups, and their independent SQL checks."""

from pyspark.sql import functions as F

from dotloom.functions.scalars import dot, normalised
from dotloom.operators import groups as G
from dotloom.operators import masks as M
from dotloom.operators import relations as R
from dotloom.operators import scoring as V
from dotloom.plans.registry import match_candidates
from dotloom.plans.scoring import BASE, _scored, _vectors
from dotloom.sources import derived as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name, sql):
    def put(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


#: Lowest affinity of an edge, share of a candidate inside another that makes it a part, least probability that is no noise.
AFFINE, PART, SURE = 0.12, 0.8, 0.25

PAIRS = BASE.replace("WITH ", "WITH RECURSIVE ", 1) + """mi AS (SELECT c.cand_id AS i, d.cand_id AS j, sum(least(c.xe,d.xe)-greatest(c.xs,d.xs)) AS n FROM cand_run c JOIN cand_run d ON c.image_id=d.image_id AND c.y=d.y AND c.cand_id<d.cand_id AND c.xs<d.xe AND d.xs<c.xe GROUP BY 1,2),
p0 AS (SELECT c.image_id, c.cand_id AS i, d.cand_id AS j, CAST(x.a AS DOUBLE) AS a, CAST(y.a AS DOUBLE) AS b, CAST(coalesce(n,0) AS DOUBLE) AS n, list_cosine_similarity(ei.z, ej.z) AS cosine, u.valid*v.valid=1 AS ok, u.valid*v.valid=1 AND u.matched_class=v.matched_class AS y_sem,
 u.valid*v.valid=1 AND u.matched_instance_id=v.matched_instance_id AS y_inst, u.coverage AS ci, v.coverage AS cj, u.purity*u.valid AS wi, v.purity*v.valid AS wj
 FROM cand c JOIN cand d ON c.image_id=d.image_id AND c.cand_id<d.cand_id AND c.cand_id%5<>0 AND d.cand_id%5<>0 JOIN ca x ON x.cand_id=c.cand_id JOIN ca y ON y.cand_id=d.cand_id JOIN e ei ON ei.cand_id=c.cand_id JOIN e ej ON ej.cand_id=d.cand_id
 JOIN m u ON u.cand_id=c.cand_id JOIN m v ON v.cand_id=d.cand_id LEFT JOIN mi ON mi.i=c.cand_id AND mi.j=d.cand_id),
pp AS (SELECT *, n/(a+b-n) AS mask_iou, n/a AS inside_i, n/b AS inside_j, CASE WHEN y_inst THEN n/a*greatest(0,cj-ci) ELSE 0 END AS y_part FROM p0),
pb AS (SELECT cand_id, class_idx, exp(cs/0.2)/sum(exp(cs/0.2)) OVER (PARTITION BY cand_id) AS p FROM sc), tc AS (SELECT cand_id, class_idx AS top_class, p AS best FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, class_idx) AS r FROM pb) WHERE r=1),
af AS (SELECT pp.image_id, pp.i, pp.j, any_value(cosine) AS cosine, any_value(mask_iou) AS mask_iou, sum(x.p*y.p)/(1+exp(-4*any_value(cosine))) AS affinity FROM pp JOIN pb x ON x.cand_id=pp.i JOIN pb y ON y.cand_id=pp.j AND y.class_idx=x.class_idx GROUP BY 1,2,3),
"""


def _pairs(spark, sf):
    """Features and labels of the pairs i < j of scored candidates of an image."""
    c = S.candidates(spark, sf).where("cand_id % 5 <> 0")
    runs = S.candidate_runs(c)
    m = match_candidates(spark, sf).select("cand_id", "valid", "matched_class", "matched_instance_id", "coverage", "purity")
    row = M.areas(runs, "cand_id", "a").join(m, "cand_id").join(_vectors(spark, sf).select("cand_id", "z"), "cand_id")
    row = row.select("image_id", "cand_id", F.struct("a", "valid", "matched_class", "matched_instance_id", "coverage", "purity", normalised(F.col("z")).alias("unit")).alias("s"))
    i, j = row.withColumnsRenamed({"cand_id": "i", "s": "u"}), row.withColumnsRenamed({"cand_id": "j", "s": "v"})
    n = M.intersections(runs.withColumnRenamed("cand_id", "i_id"), runs.withColumnRenamed("cand_id", "j_id")).where("i_id < j_id").select("image_id", F.col("i_id").alias("i"), F.col("j_id").alias("j"), F.col("inter").alias("n"))
    p = i.join(j, "image_id").where("i < j").join(n, ["image_id", "i", "j"], "left").fillna(0, ["n"])
    ok = F.expr("u.valid * v.valid = 1")
    inst = ok & F.expr("u.matched_instance_id = v.matched_instance_id")
    return p.select(
        "image_id", "i", "j", dot(F.col("u.unit"), F.col("v.unit")).alias("cosine"), F.expr("n/(u.a+v.a-n) AS mask_iou"), F.expr("n/u.a AS inside_i"), F.expr("n/v.a AS inside_j"), F.expr("v.a > u.a AS j_larger"), F.expr("u.a > v.a AS i_larger"),
        ok.alias("ok"), (ok & F.expr("u.matched_class = v.matched_class")).alias("y_sem"), inst.alias("y_inst"), F.when(inst, F.expr("n/u.a*greatest(0,v.coverage-u.coverage)")).otherwise(0.0).alias("y_part"), F.expr("u.purity*u.valid AS wi"), F.expr("v.purity*v.valid AS wj"), F.expr("u.coverage AS cov_i"), F.expr("v.coverage AS cov_j"),
    )


def _probs(spark, sf):
    """(cand_id, p, z, top_class, confidence) of the scored candidates."""
    s = _scored(spark, sf).withColumns({"p": V.probabilities("cosine", 0.2), "top_class": V.predicted("cosine")})
    return s.select("cand_id", "z", "p", "top_class", F.array_max("p").alias("confidence"))


def _affine(spark, sf, probs=None):
    return R.affinity(_pairs(spark, sf).withColumn("a_sem", F.col("cosine") * 4), probs if probs is not None else _probs(spark, sf))


def _inputs(spark, sf):
    """Pairs with their affinity, and the candidates' features: many steps read them, so they are written once."""
    features = G.cut(_probs(spark, sf).join(match_candidates(spark, sf).select("cand_id", "valid"), "cand_id"))
    return G.cut(_affine(spark, sf, features)), features


@_add("symmetric_scores", PAIRS + "y AS (SELECT 1) SELECT i, j, round((0.6*inside_i+0.4*cosine + 0.6*inside_j+0.4*cosine)/2,6) AS score FROM pp")
def symmetric_scores(spark, sf):
    """The mean of both directions of a directed score."""
    p = _pairs(spark, sf)
    one = lambda i, j, x: p.select(F.col(i).alias("i"), F.col(j).alias("j"), (F.col(x) * 0.6 + F.col("cosine") * 0.4).alias("score"))
    return R.symmetric(one("i", "j", "inside_i").union(one("j", "i", "inside_j")), "score").withColumn("score", F.round("score", 6))


@_add("relation_loss", PAIRS + """b AS (SELECT wi*wj AS w, 4*cosine AS s, 8*mask_iou-4 AS i, 6*inside_i-3 AS q, CAST(y_sem AS INT) AS ys, CAST(y_inst AS INT) AS yi, y_part AS yp FROM pp),
g AS (SELECT sum(w*(greatest(s,0)-s*ys+ln(1+exp(-abs(s))))) AS sem, sum(w*(greatest(i,0)-i*yi+ln(1+exp(-abs(i))))) AS inst, sum(w*(greatest(q,0)-q*yp+ln(1+exp(-abs(q))))) AS part FROM b)
SELECT round(sem,4) AS sem, round(inst,4) AS inst, round(part,4) AS part, round(sem+inst+part,4) AS total FROM g""")
def relation_loss(spark, sf):
    p = _pairs(spark, sf).withColumns({"a_sem": F.col("cosine") * 4, "a_inst": F.col("mask_iou") * 8 - 4, "a_part": F.col("inside_i") * 6 - 3})
    return R.relation_loss(p).select(*[F.round(k, 4).alias(k) for k in ("sem", "inst", "part", "total")])


@_add("pair_sampling", PAIRS + """s AS (SELECT *, CASE WHEN NOT ok THEN 'invalid' WHEN y_inst AND y_part>0 THEN 'part_whole' WHEN y_inst THEN 'same_instance' WHEN cosine>0.3 OR mask_iou>0 THEN 'hard_negative' WHEN y_sem THEN 'same_class' ELSE 'different_class' END AS stratum, (i*7919+j*104729)%1000003 AS h FROM pp),
q AS (SELECT image_id, 3*count(*) AS quota FROM s WHERE stratum IN ('part_whole','same_instance') GROUP BY 1),
n AS (SELECT s.*, quota, row_number() OVER (PARTITION BY s.image_id, stratum='hard_negative' ORDER BY h, i, j) AS k FROM s JOIN q USING (image_id) WHERE stratum NOT IN ('part_whole','same_instance')),
o AS (SELECT *, CASE WHEN stratum='hard_negative' AND k<=ceil(quota*CAST(0.3 AS DOUBLE)) THEN 0 WHEN stratum<>'hard_negative' THEN 1 ELSE 2 END AS f FROM n),
t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY f, h, i, j) AS at_ FROM o)
SELECT image_id, i, j, stratum FROM s WHERE stratum IN ('part_whole','same_instance') UNION ALL SELECT image_id, i, j, stratum FROM t WHERE at_<=quota""")
def pair_sampling(spark, sf):
    """Positive pairs, and three negatives for each, hard ones first up to their share."""
    return R.sample_pairs(R.strata(_pairs(spark, sf)))


RANK = """st AS (SELECT {s} AS s, count(*) FILTER (WHERE {t}) AS p, count(*) FILTER (WHERE NOT {t}) AS n FROM {f} GROUP BY 1), ru AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM st WINDOW w AS (ORDER BY s DESC))
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(CAST(sum(n*(2*tp-p)) AS DOUBLE)/(2*CAST(sum(p)*sum(n) AS DOUBLE)),10) AS auc, round(sum(p*tp/CAST(tp+fp AS DOUBLE))/sum(p),10) AS ap FROM ru"""
#: Inner products added up from left to right, so that both engines' doubles are the same.
FOLD = "list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(generate_series(1, 64), lambda k : {a}[k]*{b}[k])), lambda s, x : s+x)"
UNITS = f"""eu AS MATERIALIZED (SELECT cand_id, list_transform(z, lambda x : x/nz) AS u FROM (SELECT cand_id, z, greatest(sqrt({FOLD.format(a="z", b="z")}), 1e-12) AS nz FROM e)),
px AS MATERIALIZED (SELECT pp.*, {FOLD.format(a="x.u", b="y.u")} AS cosine_x FROM pp JOIN eu x ON x.cand_id=i JOIN eu y ON y.cand_id=j),"""


@_add("instance_ranking", PAIRS + RANK.format(s="mask_iou", t="y_inst", f="pp"))
def instance_ranking(spark, sf):
    return R.ranking(_pairs(spark, sf), "mask_iou", "y_inst")


@_add("semantic_ranking", PAIRS + UNITS + RANK.format(s="cosine_x", t="y_sem", f="px"))
def semantic_ranking(spark, sf):
    return R.ranking(_pairs(spark, sf), "cosine", "y_sem")


@_add("part_direction", PAIRS + "y AS (SELECT CASE WHEN inside_i=inside_j THEN 0.5 WHEN (inside_i>inside_j)=(yi>yj) THEN 1 ELSE 0 END AS hit FROM (SELECT *, CASE WHEN y_inst THEN n/a*greatest(0,cj-ci) ELSE 0 END AS yi, CASE WHEN y_inst THEN n/b*greatest(0,ci-cj) ELSE 0 END AS yj FROM pp) WHERE yi<>yj) SELECT count(*) AS pairs, round(avg(hit),10) AS accuracy FROM y")
def part_direction(spark, sf):
    """How often the part score names the part and the whole of a pair the right way round."""
    p = _pairs(spark, sf)
    other = F.when(F.col("y_inst"), F.expr("inside_j*greatest(0,cov_i-cov_j)")).otherwise(0.0)
    both = p.select("i", "j", F.col("inside_i").alias("a_part"), "y_part").union(p.select("j", "i", "inside_j", other))
    return R.direction_accuracy(both).withColumn("accuracy", F.round("accuracy", 10))


@_add("part_ranking", PAIRS + "pd AS (SELECT inside_i AS s, y_part>0 AS t FROM pp UNION ALL SELECT inside_j, y_inst AND n/b*greatest(0,ci-cj)>0 FROM pp)," + RANK.format(s="s", t="t", f="pd"))
def part_ranking(spark, sf):
    """The directed part score against the part-whole target."""
    p = _pairs(spark, sf)
    return R.ranking(p.select(F.col("inside_i").alias("s"), F.expr("y_part > 0 AS t")).union(p.select("inside_j", F.expr("y_inst AND inside_j*greatest(0,cov_i-cov_j) > 0"))), "s", "t")


@_add("group_affinity", PAIRS + "y AS (SELECT 1) SELECT i, j, round(affinity,6) AS affinity FROM af")
def group_affinity(spark, sf):
    return _affine(spark, sf).select("i", "j", F.round("affinity", 6).alias("affinity"))


EDGES = PAIRS + f"""bk AS (SELECT af.* FROM af JOIN tc x ON x.cand_id=i JOIN tc y ON y.cand_id=j AND y.top_class=x.top_class),
dr AS (SELECT image_id, i, j, affinity FROM bk UNION ALL SELECT image_id, j, i, affinity FROM bk),
fn AS (SELECT DISTINCT image_id, least(i,j) AS i, greatest(i,j) AS j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY affinity DESC, j) AS r FROM dr) WHERE r=1 AND affinity>={AFFINE})"""


def _edges(affine, features):
    return G.first_neighbours(G.bucketed(affine, features).select("image_id", "i", "j", "affinity"), "affinity", AFFINE)


@_add("first_neighbours", EDGES + "SELECT image_id, i, j FROM fn")
def first_neighbours(spark, sf):
    return _edges(*_inputs(spark, sf))


MEMBERS = EDGES + """, nd AS (SELECT image_id, cand_id FROM cand WHERE cand_id%5<>0), ed AS (SELECT i, j FROM fn UNION SELECT j, i FROM fn),
rc AS (SELECT cand_id AS src, cand_id AS dst FROM nd UNION SELECT rc.src, ed.j FROM rc JOIN ed ON ed.i=rc.dst), gm AS (SELECT nd.image_id, min(dst) AS group_id, src AS cand_id FROM rc JOIN nd ON nd.cand_id=src GROUP BY nd.image_id, src)"""


def _members(spark, sf, affine, features):
    nodes = S.candidates(spark, sf).where("cand_id % 5 <> 0").select("image_id", "cand_id")
    return G.components(nodes, _edges(affine, features))


@_add("candidate_groups", MEMBERS + "SELECT image_id, cand_id, group_id FROM gm")
def candidate_groups(spark, sf):
    return _members(spark, sf, *_inputs(spark, sf)).select("image_id", "cand_id", "group_id")


def _cost_sql(members: str, out: str) -> str:
    """Cost terms of the groups of a table (image_id, group_id, cand_id), as table ``out``."""
    return f"""{out}p AS (SELECT image_id, group_id, class_idx, avg(p) AS v FROM {members} JOIN pb USING (cand_id) GROUP BY 1,2,3), {out}e AS (SELECT image_id, group_id, -sum(CASE WHEN v>0 THEN v*ln(v) ELSE 0 END) AS entropy FROM {out}p GROUP BY 1,2),
{out}z AS (SELECT g.image_id, g.group_id, g.cand_id, k, v, avg(v) OVER (PARTITION BY g.image_id, g.group_id, k) AS c FROM {members} g JOIN (SELECT cand_id, unnest(z) AS v, unnest(generate_series(1, 64)) AS k FROM e) USING (cand_id)),
{out}d AS (SELECT image_id, group_id, avg(d) AS dispersion FROM (SELECT image_id, group_id, cand_id, sqrt(sum((v-c)*(v-c))) AS d FROM {out}z GROUP BY 1,2,3) GROUP BY 1,2),
{out}n AS (SELECT g.image_id, g.group_id, count(*) AS n, avg(CASE WHEN m.valid>0 AND best>={SURE} THEN 0.0 ELSE 1.0 END) AS noise FROM {members} g JOIN m USING (cand_id) JOIN tc USING (cand_id) GROUP BY 1,2),
{out}i AS (SELECT x.image_id, x.group_id, avg(-ln(affinity+0.000001)) AS inconsistency FROM {members} x JOIN {members} y ON x.image_id=y.image_id AND x.group_id=y.group_id JOIN af ON af.i=x.cand_id AND af.j=y.cand_id GROUP BY 1,2),
{out} AS (SELECT image_id, group_id, n, entropy, coalesce(inconsistency,0) AS inconsistency, dispersion, noise, entropy+coalesce(inconsistency,0)+dispersion+noise+0.1 AS cost FROM {out}n JOIN {out}e USING (image_id, group_id) JOIN {out}d USING (image_id, group_id) LEFT JOIN {out}i USING (image_id, group_id))"""


@_add("group_costs", MEMBERS + "," + _cost_sql("gm", "co") + "SELECT image_id, group_id, n, round(entropy,5) AS entropy, round(inconsistency,5) AS inconsistency, round(dispersion,5) AS dispersion, round(CAST(noise AS DOUBLE),5) AS noise, round(cost,5) AS cost FROM co")
def group_costs(spark, sf):
    a, features = _inputs(spark, sf)
    c = G.costs(_members(spark, sf, a, features), features, a, noise_below=SURE)
    return c.select("image_id", "group_id", "n", *[F.round(k, 5).alias(k) for k in ("entropy", "inconsistency", "dispersion", "noise", "cost")])


MERGES = MEMBERS + "," + _cost_sql("gm", "co") + """, tw AS (SELECT DISTINCT af.image_id, least(x.group_id,y.group_id) AS a, greatest(x.group_id,y.group_id) AS b FROM af JOIN gm x ON x.cand_id=af.i JOIN gm y ON y.cand_id=af.j WHERE x.group_id<>y.group_id),
gu AS (SELECT tw.image_id, a || '_' || b AS group_id, gm.cand_id FROM tw JOIN gm ON gm.image_id=tw.image_id AND gm.group_id IN (a, b)),""" + _cost_sql("gu", "cu") + """,
gn AS (SELECT tw.image_id, a, b, ca_.cost+cb_.cost-cu.cost AS gain FROM tw JOIN cu ON cu.image_id=tw.image_id AND cu.group_id=a || '_' || b JOIN co ca_ ON ca_.image_id=tw.image_id AND ca_.group_id=a JOIN co cb_ ON cb_.image_id=tw.image_id AND cb_.group_id=b)"""


def _gains(spark, sf):
    a, features = _inputs(spark, sf)
    members = _members(spark, sf, a, features)
    return members, features, G.merge_gains(members, features, a, noise_below=SURE)


@_add("group_merges", MERGES + "SELECT image_id, a, b, round(gain,5) AS gain FROM gn")
def group_merges(spark, sf):
    """What merging two groups of an image saves."""
    return _gains(spark, sf)[2].select("image_id", "a", "b", F.round("gain", 5).alias("gain"))


@_add("merged_groups", MERGES + f""", en AS (SELECT image_id, a AS g, b AS o, gain FROM gn WHERE gain>1e-9 UNION ALL SELECT image_id, b, a, gain FROM gn WHERE gain>1e-9), be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, g ORDER BY gain DESC, o) AS r FROM en) WHERE r=1),
mu AS (SELECT x.image_id, x.g, x.o FROM be x JOIN be y ON x.image_id=y.image_id AND x.o=y.g AND y.o=x.g WHERE x.o<x.g), mg AS (SELECT gm.image_id, cand_id, coalesce(mu.o, group_id) AS group_id FROM gm LEFT JOIN mu ON mu.image_id=gm.image_id AND mu.g=gm.group_id)
SELECT image_id, cand_id, group_id, count(*) OVER (PARTITION BY image_id, group_id)=1 AND best<{SURE} AS noise FROM mg JOIN tc USING (cand_id)""")
def merged_groups(spark, sf):
    """One round of merging by mutual best gain; unsure single candidates are noise."""
    members, features, gains = _gains(spark, sf)
    return G.isolated(G.merged(members, G.cut(gains)), features, SURE)


#: Affinity, entropy and inconsistency of a split.
SPLIT, MIXED, LOOSE = 0.14, 1.5, 1.0


def _round_sql(old: str, new: str, k: int) -> str:
    """One round of merging the groups of table ``old``."""
    return _cost_sql(old, f"ca{k}") + f""", tw{k} AS (SELECT DISTINCT af.image_id, least(x.group_id,y.group_id) AS a, greatest(x.group_id,y.group_id) AS b FROM af JOIN {old} x ON x.cand_id=af.i JOIN {old} y ON y.cand_id=af.j WHERE x.group_id<>y.group_id),
gu{k} AS (SELECT t.image_id, a || '_' || b AS group_id, g.cand_id FROM tw{k} t JOIN {old} g ON g.image_id=t.image_id AND g.group_id IN (a, b)),""" + _cost_sql(f"gu{k}", f"cu{k}") + f""",
gn{k} AS MATERIALIZED (SELECT t.image_id, a, b, u.cost+v.cost-w.cost AS gain FROM tw{k} t JOIN cu{k} w ON w.image_id=t.image_id AND w.group_id=a || '_' || b JOIN ca{k} u ON u.image_id=t.image_id AND u.group_id=a JOIN ca{k} v ON v.image_id=t.image_id AND v.group_id=b),
en{k} AS (SELECT image_id, a AS g, b AS o, gain FROM gn{k} WHERE gain>1e-9 UNION ALL SELECT image_id, b, a, gain FROM gn{k} WHERE gain>1e-9), be{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, g ORDER BY gain DESC, o) AS r FROM en{k}) WHERE r=1),
mu{k} AS (SELECT x.image_id, x.g, x.o FROM be{k} x JOIN be{k} y ON x.image_id=y.image_id AND x.o=y.g AND y.o=x.g WHERE x.o<x.g), {new} AS MATERIALIZED (SELECT q.image_id, cand_id, coalesce(m_.o, group_id) AS group_id FROM {old} q LEFT JOIN mu{k} m_ ON m_.image_id=q.image_id AND m_.g=q.group_id)"""


#: An image has at most ten scored candidates, so nine rounds are enough.
REFINED = (MEMBERS + "," + _cost_sql("gm", "co") + f""", bd AS (SELECT * FROM co WHERE entropy>{MIXED} OR inconsistency>{LOOSE}),
ow AS (SELECT af.i, af.j, affinity FROM af JOIN gm x ON x.cand_id=i JOIN gm y ON y.cand_id=j AND y.group_id=x.group_id JOIN bd ON bd.group_id=x.group_id), od AS (SELECT * FROM ow UNION ALL SELECT j, i, affinity FROM ow),
fs AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY affinity DESC, j) AS r FROM od) WHERE r=1 AND affinity>={SPLIT}), es AS (SELECT i, j FROM fs UNION SELECT j, i FROM fs),
rs2 AS (SELECT cand_id AS src, cand_id AS dst FROM gm JOIN bd USING (group_id) UNION SELECT rs2.src, es.j FROM rs2 JOIN es ON es.i=rs2.dst), sp AS MATERIALIZED (SELECT gm.image_id, min(dst) AS group_id, src AS cand_id FROM rs2 JOIN gm ON gm.cand_id=src GROUP BY gm.image_id, src),
""" + _cost_sql("sp", "cs") + """, tt AS (SELECT g.group_id, sum(cost) AS after FROM (SELECT DISTINCT gm.group_id, sp.group_id AS part FROM gm JOIN sp USING (cand_id)) g JOIN cs ON cs.group_id=g.part GROUP BY 1), bt AS (SELECT bd.group_id FROM bd JOIN tt USING (group_id) WHERE after<cost),
g0 AS MATERIALIZED (SELECT gm.image_id, gm.cand_id, CASE WHEN gm.group_id IN (SELECT group_id FROM bt) THEN sp.group_id ELSE gm.group_id END AS group_id FROM gm LEFT JOIN sp USING (cand_id)),
""" + ", ".join(_round_sql(f"g{k}", f"g{k + 1}", k) for k in range(9)) + f"""
SELECT image_id, cand_id, group_id, count(*) OVER (PARTITION BY image_id, group_id)=1 AND best<{SURE} AS noise FROM g9 JOIN tc USING (cand_id)""").replace("), pb AS (", "), pb AS MATERIALIZED (").replace("\npb AS (", "\npb AS MATERIALIZED (").replace("tc AS (", "tc AS MATERIALIZED (").replace("\naf AS (", "\naf AS MATERIALIZED (").replace("gm AS (", "gm AS MATERIALIZED (").replace("\npp AS (", "\npp AS MATERIALIZED (")


@_add("refined_groups", REFINED)
def refined_groups(spark, sf):
    """Groups split, then merged until no pair of groups gains."""
    a, features = _inputs(spark, sf)
    return G.refined(_members(spark, sf, a, features), features, a, SPLIT, SURE, limits={"most_entropy": MIXED, "most_inconsistency": LOOSE}, noise_below=SURE)


COMPS = MEMBERS + """, dj AS (SELECT i, j, inside_i AS ap, mask_iou AS iou, b>a AS larger FROM pp UNION ALL SELECT j, i, inside_j, mask_iou, a>b FROM pp), ie AS (SELECT dj.i, dj.j FROM dj JOIN gm x ON x.cand_id=dj.i JOIN gm y ON y.cand_id=dj.j AND y.group_id=x.group_id WHERE iou>=0.3),
rd AS (SELECT cand_id AS src, cand_id AS dst FROM gm UNION SELECT rd.src, ie.j FROM rd JOIN ie ON ie.i=rd.dst), cp AS (SELECT gm.image_id, gm.group_id, min(dst) AS comp_id, gm.cand_id FROM rd JOIN gm ON gm.cand_id=src GROUP BY 1,2,4),
ft AS (SELECT cand_id, best AS confidence, a/CAST(w*h AS DOUBLE) AS completeness FROM tc JOIN cand USING (cand_id) JOIN ca USING (cand_id)),
ins AS (SELECT dj.*, fi.confidence AS ci, fj.confidence AS cj FROM dj JOIN cp x ON x.cand_id=dj.i JOIN cp y ON y.cand_id=dj.j AND y.comp_id=x.comp_id JOIN ft fi ON fi.cand_id=dj.i JOIN ft fj ON fj.cand_id=dj.j),
ou AS (SELECT i AS cand_id, sum(ap) AS so, max(iou) FILTER (WHERE cj>ci OR (cj=ci AND j<i)) AS pen FROM ins GROUP BY 1), ic AS (SELECT j AS cand_id, sum(ap) AS si FROM ins GROUP BY 1), sz AS (SELECT comp_id, count(*)-1 AS others FROM cp GROUP BY 1),
rs AS (SELECT cp.*, confidence+completeness+CASE WHEN others>0 THEN (coalesce(si,0)-coalesce(so,0))/others ELSE 0 END-coalesce(pen,0) AS rep_score FROM cp JOIN sz USING (comp_id) JOIN ft USING (cand_id) LEFT JOIN ou USING (cand_id) LEFT JOIN ic USING (cand_id))"""


def _directed(p):
    return p.select("i", "j", F.col("inside_i").alias("a_part"), F.col("mask_iou").alias("iou"), F.col("j_larger").alias("larger")).union(p.select("j", "i", "inside_j", "mask_iou", "i_larger"))


def _rep_scores(spark, sf):
    a, probs = _inputs(spark, sf)
    members, directed = _members(spark, sf, a, probs), _directed(a)
    g = lambda c: members.select(F.col("cand_id").alias(c), F.col("group_id").alias(f"g{c}"))
    same = a.where("mask_iou >= 0.3").join(g("i"), "i").join(g("j"), "j").where("gi = gj").select("image_id", "i", "j")
    comp = G.components(members.select("image_id", "cand_id"), same).select("cand_id", F.col("group_id").alias("comp_id"))
    c = S.candidates(spark, sf)
    fill = c.join(M.areas(S.candidate_runs(c), "cand_id", "a"), ["image_id", "cand_id"]).select("cand_id", F.expr("a/(w*h) AS completeness"))
    features = probs.select("cand_id", "confidence").join(fill, "cand_id")
    return members, directed, probs, G.representative_scores(members.join(comp, "cand_id").select("image_id", "group_id", "comp_id", "cand_id"), features, directed)


@_add("rep_scores", COMPS + "SELECT image_id, group_id, comp_id, cand_id, round(rep_score,5) AS rep_score FROM rs")
def rep_scores(spark, sf):
    return _rep_scores(spark, sf)[3].withColumn("rep_score", F.round("rep_score", 5))


COUNTS = COMPS + f""", rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY comp_id ORDER BY round(rep_score,6) DESC, cand_id) AS r FROM rs) WHERE r=1),
kp AS (SELECT * FROM rp WHERE NOT EXISTS (SELECT 1 FROM dj JOIN rp o ON o.cand_id=dj.j WHERE dj.i=rp.cand_id AND o.group_id=rp.group_id AND larger AND ap>={PART})),
mp AS (SELECT * FROM (SELECT group_id, class_idx, v, row_number() OVER (PARTITION BY group_id ORDER BY v DESC, class_idx) AS r FROM (SELECT group_id, class_idx, avg(p) AS v FROM kp JOIN pb USING (cand_id) GROUP BY 1,2)) WHERE r=1),
gc AS (SELECT g.image_id, g.group_id, count(*) AS n_candidates, (SELECT count(*) FROM kp WHERE kp.group_id=g.group_id) AS count FROM gm g GROUP BY 1,2),
gl AS (SELECT gc.*, coalesce(class_idx,-1) AS class_idx, coalesce(v,0) AS confidence, CASE WHEN coalesce(v,0)<{SURE} AND count>1 THEN 'unknown_repeated_pattern' WHEN coalesce(v,0)<{SURE} THEN 'unknown_object' WHEN class_idx=9 THEN 'background' ELSE 'object' END AS kind FROM gc LEFT JOIN mp USING (group_id))"""


def _labels(spark, sf):
    members, directed, probs, scored = _rep_scores(spark, sf)
    reps = G.cut(G.without_parts(G.representatives(scored), directed, PART))
    return G.group_labels(reps, probs, G.group_counts(members, reps), SURE, [9])


@_add("count_groups", COUNTS + "SELECT image_id, group_id, n_candidates, count, class_idx, round(confidence,5) AS confidence, kind FROM gl")
def count_groups(spark, sf):
    """Candidates, counted instances, class and kind of each group."""
    return _labels(spark, sf).withColumn("confidence", F.round("confidence", 5))


@_add("result_json", COUNTS + "SELECT image_id, CAST(to_json({'groups': list({'group_id': group_id, 'class_idx': class_idx, 'kind': kind, 'count': count} ORDER BY group_id)}) AS VARCHAR) AS result FROM gl GROUP BY 1")
def result_json(spark, sf):
    return G.result_json(_labels(spark, sf))
