"""Pairs of candidates: symmetric scores, relation losses, sampling, affinity, and ranking measures."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dotloom.functions.scalars import dot, sigmoid
from dotloom.operators import scoring as V
from dotloom.operators.prefix import running_sums


def symmetric(pairs: DataFrame, score: str) -> DataFrame:
    """(i, j, score) with i < j: the mean of both directions of a directed score; a missing direction counts 0."""
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    return pairs.where("i <> j").groupBy(lo.alias("i"), hi.alias("j")).agg((F.sum(score) / 2).alias(score))


def relation_loss(pairs: DataFrame) -> DataFrame:
    """One row (sem, inst, part, total) of weighted sums of binary cross entropies.

    ``pairs`` has the weights wi and wj, logits a_sem, a_inst and a_part, and targets y_sem, y_inst and y_part.
    """
    w = F.col("wi") * F.col("wj")
    parts = [F.coalesce(F.sum(w * V.bce(F.col(f"a_{k}"), F.col(f"y_{k}").cast("double"))), F.lit(0.0)).alias(k) for k in ("sem", "inst", "part")]
    return pairs.agg(*parts).withColumn("total", F.col("sem") + F.col("inst") + F.col("part"))


def strata(pairs: DataFrame, part: float = 0.0, hard_cosine: float = 0.3) -> DataFrame:
    """Adds ``stratum`` and ``positive``. Negatives are hard where they look alike or overlap."""
    valid = F.col("ok")
    kind = (
        F.when(~valid, "invalid").when(F.col("y_inst") & (F.col("y_part") > part), "part_whole").when(F.col("y_inst"), "same_instance")
        .when((F.col("cosine") > hard_cosine) | (F.col("mask_iou") > 0), "hard_negative").when(F.col("y_sem"), "same_class").otherwise("different_class")
    )
    return pairs.withColumn("stratum", kind).withColumn("positive", F.col("stratum").isin("same_instance", "part_whole"))


def sample_pairs(pairs: DataFrame, ratio: int = 3, hard_share: float = 0.3, seed: int = 0) -> DataFrame:
    """All positive pairs of an image, and at most ``ratio`` negatives (or invalid pairs) for each: hard ones first, up to their share, then others by a seeded hash, then hard ones again."""
    h = F.pmod(F.col("i") * 7919 + F.col("j") * 104_729 + seed * 31, F.lit(1_000_003))
    d = pairs.withColumn("hash", h)
    n = d.groupBy("image_id").agg((F.count_if("positive") * ratio).alias("quota"))
    neg = d.where("NOT positive").join(n, "image_id").where("quota > 0")
    hard = F.col("stratum") == "hard_negative"
    w = Window.partitionBy("image_id", "hard").orderBy("hash", "i", "j")
    neg = neg.withColumn("hard", hard).withColumn("place", F.row_number().over(w))
    first = F.when(F.col("hard") & (F.col("place") <= F.ceil(F.col("quota") * hard_share)), 0).when(~F.col("hard"), 1).otherwise(2)
    order = Window.partitionBy("image_id").orderBy("first", "hash", "i", "j")
    neg = neg.withColumn("first", first).withColumn("at", F.row_number().over(order)).where("at <= quota")
    return d.where("positive").select("image_id", "i", "j", "stratum").union(neg.select("image_id", "i", "j", "stratum"))


def affinity(pairs: DataFrame, probs: DataFrame, logit: str = "a_sem") -> DataFrame:
    """Adds ``affinity``: the inner product of both class distributions (cand_id, p) times the sigmoid of the semantic logit."""
    a, b = probs.select(F.col("cand_id").alias("i"), F.col("p").alias("pi")), probs.select(F.col("cand_id").alias("j"), F.col("p").alias("pj"))
    return pairs.join(a, "i").join(b, "j").withColumn("affinity", dot(F.col("pi"), F.col("pj")) * sigmoid(F.col(logit))).drop("pi", "pj")


def ranking(scores: DataFrame, score: str, target: str, digits: int = 10) -> DataFrame:
    """One row (positives, negatives, auc, ap) of a score against a boolean target; null without both kinds.

    Equal scores are one step and count half; rows without score or target don't count. Steps are summed up over ranges
    of the score (``running_sums``). ``digits`` rounds the result alone.
    """
    t = F.col(target)
    steps = scores.where(F.col(score).isNotNull() & t.isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(t).alias("p"), F.count_if(~t).alias("n"))
    run = running_sums(steps, [], -F.col("s"), "p", "n")
    whole = "decimal(38,0)"
    # Twice the pairs that are in order, ties half: whole numbers.
    above = F.sum(F.col("n").cast(whole) * (2 * F.col("p_to") - F.col("p")).cast("decimal(20,0)"))
    a = run.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), above.alias("above"), F.sum(F.col("p") * F.col("p_to") / (F.col("p_to") + F.col("n_to"))).alias("area"))
    both = 2 * F.col("positives").cast("double") * F.col("negatives")
    return a.select(
        F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("negatives", F.lit(0)).alias("negatives"),
        F.round(F.try_divide(F.col("above").cast("double"), both), digits).alias("auc"), F.round(F.try_divide(F.col("area"), F.col("positives")), digits).alias("ap"),
    )


def direction_accuracy(directed: DataFrame) -> DataFrame:
    """One row (pairs, accuracy) over pairs whose part-whole target differs between both directions of (i, j, a_part, y_part): the share with the larger score where the target is larger; equal scores count half."""
    lo, hi, up = F.least("i", "j"), F.greatest("i", "j"), F.col("i") < F.col("j")
    one = lambda c, k: F.max(F.when(k, F.col(c)))
    d = directed.where("i <> j").groupBy(lo.alias("i"), hi.alias("j")).agg(one("a_part", up).alias("a"), one("a_part", ~up).alias("b"), one("y_part", up).alias("y"), one("y_part", ~up).alias("z"))
    d = d.where("a IS NOT NULL AND b IS NOT NULL AND y <> z")
    hit = F.when(F.col("a") == F.col("b"), 0.5).otherwise(((F.col("a") > F.col("b")) == (F.col("y") > F.col("z"))).cast("double"))
    return d.agg(F.count("*").alias("pairs"), F.avg(hit).alias("accuracy"))
