"""Detection measures: greedy matching by score, average precision, recall, duplicate and error rates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotloom.operators.prefix import running_sums


def matched(preds: DataFrame, overlaps: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds ``gt_id`` (null: none) and ``duplicate`` to predictions (image_id, class_idx, cand_id, score).

    ``overlaps`` (image_id, cand_id, gt_id, iou) holds pairs of equal class. By falling score, lower id first among
    equals, each takes the free ground truth of the highest IoU of at least ``least`` (lower id among equals); one that
    finds all of its own taken is a duplicate.
    """
    good = overlaps.where(F.col("iou") >= least).groupBy("image_id", "cand_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), "gt_id"))).alias("g"))
    good = good.select("image_id", "cand_id", F.transform("g", lambda x: x["gt_id"]).alias("options"))
    rows = preds.join(good, ["image_id", "cand_id"], "left").withColumn("options", F.coalesce("options", F.expr("filter(array(cand_id), z -> false)")))
    arr = rows.groupBy("image_id", "class_idx").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "cand_id", "score", "options"))).alias("arr"))
    fold = """aggregate(arr, named_struct('used', filter(array(image_id), z -> false), 'got', filter(array(named_struct('cand_id', image_id, 'score', 0D, 'gt_id', image_id, 'duplicate', false)), z -> false)), (acc, b) ->
      named_struct('used', concat(acc.used, slice(filter(b.options, g -> NOT array_contains(acc.used, g)), 1, 1)),
      'got', concat(acc.got, array(named_struct('cand_id', b.cand_id, 'score', b.score, 'gt_id', get(filter(b.options, g -> NOT array_contains(acc.used, g)), 0),
        'duplicate', size(b.options) > 0 AND size(filter(b.options, g -> NOT array_contains(acc.used, g))) = 0))))).got"""
    return arr.select("image_id", "class_idx", F.inline(F.expr(fold)))


def precision_recall(rows: DataFrame, truths: DataFrame, digits: int = 10) -> DataFrame:
    """(class_idx, truths, ap, recall) of ``matched`` rows: the area under the precision-recall steps of each class.

    Equal scores are one step; a class of very many steps is summed up over ranges of the score. ``digits`` rounds the
    result alone.
    """
    steps = rows.groupBy("class_idx", F.col("score").alias("s")).agg(F.count("gt_id").alias("tp"), F.count("*").alias("n"))
    run = running_sums(steps, ["class_idx"], -F.col("s"), "tp", "n")
    area = run.groupBy("class_idx").agg(F.sum(F.col("tp") * F.col("tp_to") / F.col("n_to")).alias("area"), F.sum("tp").alias("hits"))
    g = truths.groupBy("class_idx").agg(F.count("*").alias("truths"))
    d = g.join(area, "class_idx", "left")
    return d.select("class_idx", "truths", F.round(F.coalesce("area", F.lit(0.0)) / F.col("truths"), digits).alias("ap"), F.round(F.coalesce("hits", F.lit(0)) / F.col("truths"), digits).alias("recall"))


def error_rates(rows: DataFrame, truths: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: shares of duplicates, false positives (duplicates included) and parts taken for instances among predictions, and of missed truths.

    ``parts`` (image_id, cand_id) lists candidates that are a part of an instance.
    """
    p = parts.select("image_id", "cand_id").distinct().withColumn("part", F.lit(True))
    r = rows.join(p, ["image_id", "cand_id"], "left")
    a = r.agg(F.count("*").alias("n"), F.count_if("duplicate").alias("dup"), F.count_if(F.col("gt_id").isNull()).alias("fp"), F.count_if(F.col("part") & F.col("gt_id").isNotNull()).alias("part"), F.count("gt_id").alias("tp"))
    g = truths.agg(F.count("*").alias("truths"))
    share = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0)), 6)
    both = a.crossJoin(F.broadcast(g))  # one row each
    return both.select("n", "truths", share("dup", "n").alias("duplicate_rate"), share("fp", "n").alias("false_positive_rate"), share("part", "n").alias("part_as_instance_rate"), F.round(F.coalesce(F.try_divide(F.col("truths") - F.col("tp"), F.col("truths")), F.lit(0.0)), 6).alias("false_negative_rate"))
