"""Vector and head scoring in DataFrame functions: prototypes, heads, ranks, losses, schedules.

The class table is gathered into rows of arrays of at most ``MOST_BYTES``, and each candidate scores the classes of a
row in place, row after row, so scoring needs no shuffle of candidates and no broadcast grows with the vocabulary.
"""

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dotloom.functions.scalars import bound, clamp, dot, norm, normalised

#: Bytes of class vectors that one broadcast row may hold.
MOST_BYTES = 32_000_000


def class_means(vectors: DataFrame, label: str = "label", z: str = "z") -> DataFrame:
    """(class_idx, mu, unit): the mean of each class's normalised vectors, and that mean normalised again; partial sums by (class, position) before the shuffle."""
    d = vectors.select(F.col(label).alias("class_idx"), F.posexplode(normalised(F.col(z))).alias("pos", "v")).groupBy("class_idx", "pos").agg(F.avg("v").alias("v"))
    rows = d.groupBy("class_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    return rows.select("class_idx", F.transform("s", lambda s: s["v"]).alias("mu")).withColumn("unit", normalised(F.col("mu")))


def expand_classes(linear: DataFrame, new: DataFrame) -> DataFrame:
    """The linear table (class_idx, w, b) with rows for new classes; those it has already keep their row."""
    return linear.unionByName(new.join(linear.select("class_idx"), "class_idx", "left_anti").select("class_idx", "w", "b"))


def class_rows(classes: DataFrame) -> list[DataFrame]:
    """The class table (class_idx, unit, w, b) as one-row tables ``classes`` of at most MOST_BYTES, in the order of class_idx."""
    s = classes.agg(F.count("*").alias("n"), F.max(F.coalesce(F.size("unit"), F.lit(0)) + F.greatest(F.size("w"), F.lit(0))).alias("width"), F.min("class_idx").alias("a"), F.max("class_idx").alias("z")).first()
    parts = max(1, math.ceil(s.n * (s.width or 1) * 8 / MOST_BYTES))
    step = -(-((s.z or 0) - (s.a or 0) + 1) // parts)
    rows = []
    for k in range(parts):
        part = classes if parts == 1 else classes.where(F.col("class_idx").between((s.a or 0) + k * step, (s.a or 0) + (k + 1) * step - 1))
        rows.append(part.agg(F.array_sort(F.collect_list(F.struct("class_idx", "unit", "w", "b"))).alias("classes")))
    return rows


def head_scores(vectors: DataFrame, means: DataFrame, linear: DataFrame | None = None, temperature: float = 0.07, raw_alpha: float = 0.0) -> DataFrame:
    """Adds ``scores``, per class: cosine, open (cosine / T), closed (linear, 0 for classes that ``linear`` lacks) and hybrid.

    T is clamped to [0.01, 0.5]; hybrid is a * open + (1 - a) * closed with a the sigmoid of ``raw_alpha``.
    """
    t, a = min(max(temperature, 0.01), 0.5), 1 / (1 + math.exp(-raw_alpha))
    kind = "array<double>"
    lin = linear.select("class_idx", F.col("w").cast(kind).alias("w"), F.col("b").cast("double").alias("b")) if linear is not None else means.limit(0).select("class_idx", F.lit(None).cast(kind).alias("w"), F.lit(None).cast("double").alias("b"))
    table = means.select("class_idx", "unit").join(lin, "class_idx", "left")
    z = F.col("z")

    def one(c, n):
        cos = dot(z, c["unit"]) / n
        closed = F.coalesce(dot(z, c["w"]) + c["b"], F.lit(0.0))
        return F.struct(c["class_idx"].alias("class_idx"), cos.alias("cosine"), (cos / t).alias("open"), closed.alias("closed"))

    wide = vectors.withColumn("scores", F.expr("CAST(array() AS array<struct<class_idx:bigint,cosine:double,open:double,closed:double>>)"))
    for row in class_rows(table):
        got = bound(norm(z), lambda n: F.transform("classes", lambda c: one(c, n)))
        wide = wide.crossJoin(F.broadcast(row)).withColumn("scores", F.concat("scores", got)).drop("classes")
    return wide.withColumn("scores", F.transform("scores", lambda s: s.withField("hybrid", s["open"] * a + s["closed"] * (1 - a))))


def heads() -> dict[str, Callable[[Column], Column]]:
    """The score of each kind of head from an element of ``scores``; margin heads score by the scaled cosine where nothing is trained."""
    return {"cosine": lambda s: s["open"], "linear": lambda s: s["closed"], "margin": lambda s: clamp(s["cosine"], -1 + 1e-6, 1 - 1e-6) * 30.0, "hybrid": lambda s: s["hybrid"]}


def with_head(scored: DataFrame, kind: str) -> DataFrame:
    """Adds the score ``logit`` of a head by its name to ``scores``. Raises ValueError for an unknown one."""
    if kind not in heads():
        raise ValueError(f"unknown head {kind!r}")
    return scored.withColumn("scores", F.transform("scores", lambda s: s.withField("logit", heads()[kind](s))))


def auxiliary(vectors: DataFrame, weights: list[float], bias: float, group_weights: list[list[float]] | None = None) -> DataFrame:
    """Adds ``countable_logit`` of the vector z, and ``group_logits`` if weights for kinds of groups are given."""
    arr = lambda w: F.array(*[F.lit(float(x)) for x in w])
    d = vectors.withColumn("countable_logit", dot(F.col("z"), arr(weights)) + bias)
    return d.withColumn("group_logits", F.array(*[dot(F.col("z"), arr(w)) for w in group_weights])) if group_weights else d


def projected(vectors: DataFrame, layers: list[tuple[list[list[float]], list[float]]]) -> DataFrame:
    """The projection (Linear, GELU) x (n - 1), Linear of z, layers as (weight rows, bias); adds ``h``. Rows of (cand_id, h).

    GELU in its exact form needs the error function, which Spark lacks: Arrow batches.
    """
    import numpy as np
    import pyarrow as pa

    shared = vectors.sparkSession.sparkContext.broadcast([(np.array(w, float), np.array(b, float)) for w, b in layers])

    def run(batches):
        erf = np.frompyfunc(math.erf, 1, 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("z").to_pylist(), float)
            for k, (w, b) in enumerate(shared.value):
                x = x @ w.T + b
                if k < len(shared.value) - 1:
                    x = x * 0.5 * (1 + erf(x / math.sqrt(2)).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("cand_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["cand_id", "h"])

    return vectors.select("cand_id", "z").mapInArrow(run, "cand_id long, h array<double>")


def at_class(field: str, target: str) -> Column:
    """The target class's score, null where the class is unknown."""
    return F.try_element_at(F.filter("scores", lambda s: s["class_idx"] == F.col(target)), F.lit(1))[field]


def rank_of(field: str, target: str) -> Column:
    """How many classes score above the target class; 0 is best."""
    rank = bound(at_class(field, target), lambda own: F.when(own.isNotNull(), F.size(F.filter("scores", lambda s: s[field] > own)).cast("long")))
    return rank


def top_classes(scored: DataFrame, field: str, k: int = 5) -> DataFrame:
    """The k best classes of each candidate, the lower id first among equals."""
    best = F.slice(F.array_sort(F.transform("scores", lambda s: F.struct((-s[field]).alias("o"), s["class_idx"].alias("class_idx")))), 1, k)
    return scored.select("cand_id", F.posexplode(best).alias("rank", "b")).select("cand_id", F.col("rank").cast("long").alias("rank"), "b.class_idx")


def predicted(field: str) -> Column:
    """The class with the highest score, the lowest id among equals."""
    best = F.array_max(F.transform("scores", lambda s: F.struct(s[field].alias("x"), (-s["class_idx"]).alias("o"))))
    return -best["o"]


def accuracy(rows: DataFrame, target: str, weight: str, *branches: str, high: float = 0.7) -> DataFrame:
    """Per branch: top-1, top-5, weighted top-1, top-1 above purity ``high``, and mean rank of the true class.

    All rows count; one whose class is unknown is a miss and has no rank.
    """
    per = rows.select(F.col(weight).alias("w"), F.explode(F.array(*[F.struct(F.lit(b).alias("branch"), rank_of(b, target).alias("rk")) for b in branches])).alias("x")).select("w", "x.*")
    hit, five = F.coalesce((F.col("rk") == 0).cast("double"), F.lit(0.0)), F.coalesce((F.col("rk") < 5).cast("double"), F.lit(0.0))
    return per.groupBy("branch").agg(
        F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("top1"), F.round(F.avg(five), 6).alias("top5"),
        F.round(F.sum(F.col("w") * hit) / F.greatest(F.sum("w"), F.lit(1e-9)), 4).alias("weighted_top1"),
        F.round(F.coalesce(F.avg(F.when(F.col("w") > high, hit)), F.lit(0.0)), 6).alias("high_purity_top1"), F.round(F.avg("rk"), 6).alias("mean_rank"),
    )


def countable(cand: DataFrame, vocabulary: DataFrame, matched: str = "matched_class") -> DataFrame:
    """Adds ``is_countable``: 1 where a valid candidate's class is countable; matches below 0 become 0 in ``export_class``."""
    v = vocabulary.select(F.col("class_idx").alias(matched), F.col("is_countable").alias("__c"))
    d = cand.join(v, matched, "left").withColumn("is_countable", F.when((F.col("valid") > 0) & F.coalesce("__c", F.lit(False)), 1.0).otherwise(0.0)).drop("__c")
    return d.withColumn("export_class", F.greatest(F.col(matched), F.lit(0)))


def class_names(rows: DataFrame, vocabulary: DataFrame, key: str = "class_idx") -> DataFrame:
    """Adds ``class_name``; ``__background__`` without a class, ``__unknown__`` outside the vocabulary."""
    v = vocabulary.select(F.col("class_idx").alias(key), F.col("name").alias("__n"))
    name = F.when(F.coalesce(F.col(key), F.lit(-1)) < 0, "__background__").otherwise(F.coalesce("__n", F.lit("__unknown__")))
    return rows.join(v, key, "left").withColumn("class_name", name).drop("__n")


def evaluation(rows: DataFrame, field: str = "logit", *by: str) -> DataFrame:
    """Top-1 and countable accuracy over the valid rows (columns scores, matched_class, valid, countable_logit, is_countable)."""
    ok = F.col("valid") > 0
    hit = F.when(ok & (predicted(field) == F.col("matched_class")), 1).otherwise(0)
    same = F.when(ok & ((F.col("countable_logit") > 0).cast("double") == F.col("is_countable")), 1).otherwise(0)
    n = F.greatest(F.count_if(ok), F.lit(1))
    return rows.groupBy(*by).agg(F.count_if(ok).alias("n_valid"), F.round(F.sum(hit) / n, 6).alias("top1"), F.round(F.sum(same) / n, 6).alias("countable_acc"))


def margin_logit(cos: Column, is_target: Column, kind: str, margin: float, scale: float) -> Column:
    """Angular ("arc") or cosine ("cos") margin at the target class, plain scaled cosine elsewhere."""
    if kind not in ("arc", "cos"):
        raise ValueError(f"unknown margin {kind!r}")
    c = clamp(cos, -1 + 1e-6, 1 - 1e-6)
    moved = F.cos(F.acos(c) + margin) if kind == "arc" else c - margin
    return F.when(is_target, moved).otherwise(c) * scale


def log_sum(field: str, temperature: float = 1.0) -> Column:
    """Logarithm of the sum of exponentials of a score over the classes."""
    xs = F.transform("scores", lambda s: s[field] / temperature)
    return bound(xs, lambda x: bound(F.array_max(x), lambda top: top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))))


def cross_entropy(field: str, target: str, temperature: float = 1.0, smoothing: float = 0.0, weights: str | None = None) -> Column:
    """-log softmax of the target class over ``scores``.

    ``weights`` names a column map<class_idx, weight>, by which each class's term counts; ``smoothing`` spreads that
    share of the target evenly over all classes.
    """
    own = lambda c: F.coalesce(F.try_element_at(F.col(weights), c), F.lit(1.0)) if weights else F.lit(1.0)
    hard = lambda lse: own(F.col(target)) * (lse - at_class(field, target) / temperature)
    if not smoothing:
        return bound(log_sum(field, temperature), hard)
    soft = lambda lse: F.aggregate("scores", F.lit(0.0), lambda a, s: a + own(s["class_idx"]) * (lse - s[field] / temperature))
    return bound(log_sum(field, temperature), lambda lse: hard(lse) * (1 - smoothing) + soft(lse) * smoothing / F.size("scores"))


def focal(ce: Column, gamma: float = 2.0, weight: Column | None = None) -> Column:
    """Focal loss from the plain cross entropy, times the target class's weight if given."""
    loss = F.pow(1 - F.exp(-ce), gamma) * ce
    return loss if weight is None else loss * weight


def probabilities(field: str, temperature: float = 1.0) -> Column:
    """Softmax over ``scores`` as an array in the order of the classes."""
    return bound(log_sum(field, temperature), lambda lse: F.transform("scores", lambda s: F.exp(s[field] / temperature - lse)))


def total_loss(cls: Column, count: Column | None = None, align: Column | None = None, lambda_count: float = 0.5, lambda_align: float = 0.0) -> Column:
    """The class loss, plus the count and alignment losses that are given, by their weights; alignment only for a weight above 0."""
    parts = [cls]
    if count is not None:
        parts.append(count * lambda_count)
    if align is not None and lambda_align > 0:
        parts.append(align * lambda_align)
    return reduce(lambda a, b: a + b, parts)


def epoch_means(batches: DataFrame, *parts: str) -> DataFrame:
    """Means of the losses of an epoch over its batches (epoch, batch, parts), each batch counting once."""
    return batches.groupBy("epoch").agg(F.count("*").alias("batches"), *[F.round(F.avg(p), 6).alias(p) for p in parts])


def bce(logit: Column, y: Column) -> Column:
    """Binary cross entropy of a logit, stable for large values."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def weighted_mean(loss: str, weight: str) -> Column:
    """Weighted mean with a floor under the weights' sum."""
    return F.sum(F.col(weight) * F.col(loss)) / F.greatest(F.sum(weight), F.lit(1e-6))


def learning_rates(spark, epochs: int, warmup: int) -> DataFrame:
    """(epoch, factor): linear warm-up, then half a cosine."""
    e = F.col("epoch")
    p = F.least(F.lit(1.0), (e - warmup) / float(max(1, epochs - warmup)))
    return spark.range(epochs).withColumnRenamed("id", "epoch").withColumn("factor", F.when(e < warmup, (e + 1) / float(max(warmup, 1))).otherwise(0.5 * (1 + F.cos(math.pi * p))))


def early_stop(metrics: DataFrame, patience: int) -> DataFrame:
    """(run, epoch, metric) up to each run's stop, with ``improved``; the first best epoch is kept. A patience of 0 or less never stops."""
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.max("metric").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = metrics.withColumn("improved", F.coalesce(F.col("metric") > before, F.lit(True)))
    if patience <= 0:
        return m.select("run", "epoch", "metric", "improved")
    m = m.withColumn("since", F.col("epoch") - F.max(F.when(F.col("improved"), F.col("epoch"))).over(w))
    stop = F.min(F.when(F.col("since") >= patience, F.col("epoch"))).over(Window.partitionBy("run"))
    return m.withColumn("stop", stop).where("stop IS NULL OR epoch <= stop").select("run", "epoch", "metric", "improved")
