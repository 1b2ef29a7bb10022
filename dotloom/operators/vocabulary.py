"""Heads over vocabularies of any size: a tile of classes at a time, with running best classes, rank and log-sum.

``scoring.head_scores`` holds all scores of a candidate in one array. Here a candidate carries a state of constant size
from tile to tile, so that neither rows, tasks nor broadcasts grow with the number of classes. Candidates are never
shuffled; each pass scores them against one broadcast tile by matrix products.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dotloom.functions.scalars import bound, clamp, dot, norm
from dotloom.sources.store import kept, scratch

#: Bytes of class vectors that one broadcast tile holds.
MOST_BYTES = 64_000_000
#: Candidates and classes of one matrix product.
ROWS, COLUMNS = 256, 4096
#: Pairs whose vectors are gathered at a time to be added up in order; equal classes may make all of a product such pairs.
PAIRS = 8192
KINDS = ("cosine", "linear", "margin", "hybrid")
STATE = T.StructType([
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("best", T.ArrayType(T.DoubleType())), T.StructField("above", T.LongType()),
    T.StructField("high", T.DoubleType()), T.StructField("mass", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("weighted", T.DoubleType()),
])


def _finite(x):
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))


def _class_table(means: DataFrame, linear: DataFrame | None, weights: DataFrame | None, width: int) -> DataFrame:
    """(class_idx, unit, w, b, weight) of the classes that have a score."""
    vectors = "array<double>"
    lin = linear.select("class_idx", F.col("w").cast(vectors).alias("w"), F.col("b").cast("double").alias("b")) if linear is not None else means.limit(0).select("class_idx", F.lit(None).cast(vectors).alias("w"), F.lit(0.0).alias("b"))
    d = means.select(F.col("class_idx").cast("long").alias("class_idx"), F.col("unit").cast(vectors).alias("unit")).join(lin, "class_idx", "left")
    ok = (F.size("w") == width) & _finite(F.col("w")) & _finite(F.array("b"))
    d = d.where(F.col("class_idx").isNotNull() & (F.size("unit") == width) & _finite(F.col("unit"))).select("class_idx", "unit", F.when(ok, F.col("w")).alias("w"), F.when(ok, F.col("b")).otherwise(0.0).alias("b"))
    if weights is None:
        return d.withColumn("weight", F.lit(1.0))
    return d.join(weights.select("class_idx", F.col("weight").cast("double").alias("weight")), "class_idx", "left").fillna(1.0, ["weight"])


def _head(kind: str, cos, closed, t: float, a: float):
    """The score of a head from the cosine and the linear score; columns and arrays alike."""
    if kind == "cosine":
        return cos / t
    if kind == "linear":
        return closed
    if kind == "margin":
        return (cos.clip(-1 + 1e-6, 1 - 1e-6) if isinstance(cos, np.ndarray) else clamp(cos, -1 + 1e-6, 1 - 1e-6)) * 30.0
    return (cos / t) * a + closed * (1 - a)


def _in_order(z: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up in the order of the positions, as the column expression does."""
    out = np.zeros(len(z))
    for k in range(z.shape[1]):
        out += z[:, k] * c[:, k]
    return out


class Tile:
    """Classes as matrices, and the score of a head against them."""

    def __init__(self, rows: pa.Table, kind: str, t: float, a: float, loss_t: float, k: int):
        rows = rows.sort_by("class_idx")
        n = rows.num_rows
        self.kind, self.t, self.a, self.loss_t, self.k = kind, t, a, loss_t, k
        self.ids = rows["class_idx"].to_numpy().astype(np.int64)
        self.unit = np.array(rows["unit"].combine_chunks().flatten(), float).reshape(n, -1)
        self.known = ~np.array(rows["w"].is_null())
        self.w = np.zeros_like(self.unit)
        self.w[self.known] = np.array(rows["w"].combine_chunks().drop_null().flatten(), float).reshape(-1, self.unit.shape[1])
        self.b, self.weight = rows["b"].to_numpy(), rows["weight"].to_numpy()

    def fast(self, z, n, part):
        """Scores by matrix products, and per candidate a bound of their distance from those added up in order."""
        u, w, b = self.unit[part], self.w[part], self.b[part]
        size = lambda m: math.sqrt((m * m).sum(1).max(initial=0.0))
        length = np.sqrt((z * z).sum(1))
        closed = z @ w.T + b if self.kind in ("linear", "hybrid") else 0.0
        cos = z @ u.T / n[:, None] if self.kind != "linear" else np.zeros((len(z), len(u)))
        scale = max(1 / self.t, 30.0) * size(u) + length * size(w) + np.abs(b).max(initial=0.0)
        return _head(self.kind, cos, closed, self.t, self.a), 8 * (z.shape[1] + 8) * np.finfo(float).eps * scale

    def exact(self, z, n, rows, classes):
        """Scores of pairs of a candidate and a class, added up in order, ``PAIRS`` at a time."""
        out = np.empty(len(rows))
        for s in range(0, len(rows), PAIRS):
            r, at = rows[s : s + PAIRS], classes[s : s + PAIRS]
            closed = np.where(self.known[at], _in_order(z[r], self.w[at]) + self.b[at], 0.0)
            out[s : s + PAIRS] = _head(self.kind, _in_order(z[r], self.unit[at]) / n[r], closed, self.t, self.a)
        return out

    def add(self, z, n, own, state):
        """Brings the states of candidates up to date; matrix products choose, scores near a border are added up in order."""
        for s in range(0, len(self.ids), COLUMNS):
            part = slice(s, s + COLUMNS)
            x, slack = self.fast(z, n, part)
            work = x / self.loss_t
            high = np.maximum(state["high"], work.max(1))
            work -= high[:, None]
            state["mass"] = state["mass"] * np.exp(state["high"] - high) + np.exp(work, out=work).sum(1)
            state["high"] = high
            state["weight"] += self.weight[part].sum()
            state["weighted"] += x @ self.weight[part]
            floor = state["best"][:, -1]
            if np.isneginf(floor).any() and x.shape[1] >= self.k:
                floor = np.maximum(floor, np.partition(x, x.shape[1] - self.k, axis=1)[:, x.shape[1] - self.k])
            with np.errstate(invalid="ignore"):
                state["above"] += (x > (own + slack)[:, None]).sum(1)
                np.subtract(x, own[:, None], out=work)
                close = np.abs(work, out=work) <= slack[:, None]
            r, c = np.nonzero(close)
            state["above"] += np.bincount(r[self.exact(z, n, r, c + s) > own[r]], minlength=len(z))
            r, c = np.nonzero(x >= (floor - 2 * slack)[:, None])
            del x, work, close
            self.best(state, r, self.ids[c + s], self.exact(z, n, r, c + s))

    def best(self, state, r, ids, score):
        """The k best of those that a candidate has and the new ones, the lower id first among equals."""
        rows = len(state["ids"])
        r = np.concatenate([np.repeat(np.arange(rows), self.k), r])
        ids, score = np.concatenate([state["ids"].ravel(), ids]), np.concatenate([state["best"].ravel(), score])
        order = np.lexsort((ids, -score, r))
        first = np.searchsorted(r[order], np.arange(rows))
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        state["ids"], state["best"] = ids[take].reshape(rows, self.k), score[take].reshape(rows, self.k)


def _columns(batch: pa.RecordBatch, width: int, k: int):
    """Candidates that have a vector: their places, vectors, norms, own scores and states."""
    seen = np.flatnonzero(np.array(batch.column("__ok")))
    some = batch.take(pa.array(seen))
    z = np.array(some.column("__z").flatten(), float).reshape(len(seen), width)
    own = some.column("__own").to_numpy(zero_copy_only=False).astype(float)
    old = some.column("__state")
    get = lambda name: old.field(name).to_numpy(zero_copy_only=False)
    state = {name: get(name).astype(float) for name in ("high", "mass", "weight", "weighted")} | {"above": get("above").astype(np.int64)}
    state["ids"] = np.array(old.field("ids").flatten(), np.int64).reshape(len(seen), k)
    state["best"] = np.array(old.field("best").flatten(), float).reshape(len(seen), k)
    return seen, z, some.column("__n").to_numpy(zero_copy_only=False), own, state


def _pass(d: DataFrame, tile, width: int, k: int) -> DataFrame:
    """The candidates with their states after one more tile."""
    fields = pa.struct([("ids", pa.list_(pa.int64())), ("best", pa.list_(pa.float64())), ("above", pa.int64()), ("high", pa.float64()), ("mass", pa.float64()), ("weight", pa.float64()), ("weighted", pa.float64())])

    def run(batches):
        for batch in batches:
            seen, z, n, own, state = _columns(batch, width, k)
            done = []
            for s in range(0, len(seen), ROWS):
                rows = slice(s, s + ROWS)
                one = {name: v[rows] for name, v in state.items()}
                tile.value.add(z[rows], n[rows], own[rows], one)
                done.append(one)
            whole = {f.name: np.concatenate([o[f.name] for o in done]) if done else state[f.name] for f in fields}
            lists = lambda v: pa.array(list(v), pa.list_(pa.int64() if v.dtype == np.int64 else pa.float64()))
            new = pa.StructArray.from_arrays([lists(v) if v.ndim == 2 else pa.array(v) for v in whole.values()], fields=list(fields))
            place = np.full(batch.num_rows, -1)
            place[seen] = np.arange(len(seen))
            new = new.take(pa.array(place, mask=place < 0))
            at = batch.schema.get_field_index("__state")
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return d.mapInArrow(run, d.schema)


def vocabulary_scores(
    vectors: DataFrame, means: DataFrame, linear: DataFrame | None = None, kind: str = "hybrid", target: str | None = None, k: int = 5, temperature: float = 0.07, raw_alpha: float = 0.0,
    loss_temperature: float = 1.0, weights: DataFrame | None = None, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Adds ``target_score``, ``rank``, ``top``, ``log_sum``, ``weight_sum``, ``score_sum`` and ``n_classes`` of a head to ``vectors`` (z and others).

    ``means`` (class_idx, unit) and ``linear`` (class_idx, w, b) are the tables of ``head_scores``, a class_idx once in
    each; ``target`` names the column of the true class, ``weights`` (class_idx, weight) weighs classes, 1 where it has
    none. ``rank``: classes above the true one, 0 is best; ``top``: the ``k`` best (class_idx, score), the lower id first
    among equals; ``log_sum``: of the exponentials of scores over ``loss_temperature``; ``weight_sum`` and ``score_sum``:
    sums of weights, and of scores by weight, as a smoothed loss needs. Ranks and best classes equal those of
    ``head_scores``, ties included: where a matrix product can't tell, scores are added up in the same order.

    A class without a finite vector of the candidates' length has no score; one whose linear row is no such vector counts
    as one without. A candidate without such a vector has no scores (null, ``top`` empty), one without a known class no
    ``target_score`` and ``rank``. Without classes ``log_sum`` is null and ``top`` is empty. Raises ValueError for an
    unknown ``kind`` and for a ``k`` below 1.
    """
    if kind not in KINDS or k < 1:
        raise ValueError(f"unknown head {kind!r}" if kind not in KINDS else "k must be at least 1")
    t, a = min(max(temperature, 0.01), 0.5), 1 / (1 + math.exp(-raw_alpha))
    width = means.agg(F.max(F.size("unit"))).first()[0] or 0
    table = _class_table(means, linear, weights, width)
    size = table.count()
    tiles = max(1, math.ceil(size * max(width, 1) * 16 / most_bytes))
    spark, path = vectors.sparkSession, None
    if tiles > 1:
        path = scratch(vectors.sparkSession, "tiles")
        table.withColumn("tile", F.pmod(F.xxhash64("class_idx"), F.lit(tiles))).repartition("tile").write.partitionBy("tile").parquet(path)
        table = spark.read.parquet(path)
    d = vectors.withColumn("__z", F.col("z").cast("array<double>"))
    d = d.withColumn("__ok", F.coalesce((F.size("__z") == width) & _finite(F.col("__z")), F.lit(False)) & F.lit(size > 0)).withColumn("__n", norm(F.col("__z")))
    own = F.lit(None).cast("double")
    if target:
        of = table.select(F.col("class_idx").alias("__c"), F.struct("unit", "w", "b").alias("__t"))
        d = d.join(of, F.col(target) == F.col("__c"), "left")
        closed = F.coalesce(dot(F.col("__z"), F.col("__t.w")) + F.col("__t.b"), F.lit(0.0))
        cos = dot(F.col("__z"), F.col("__t.unit")) / F.col("__n")
        own = F.when(F.col("__ok") & F.col("__c").isNotNull(), bound(F.struct(cos.alias("cos"), closed.alias("closed")), lambda s: _head(kind, s["cos"], s["closed"], t, a)))
    empty = F.struct(
        F.array_repeat(F.lit(2**63 - 1), k).alias("ids"), F.array_repeat(F.lit(float("-inf")), k).alias("best"), F.lit(0).cast("long").alias("above"),
        F.lit(float("-inf")).alias("high"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("weighted"),
    )
    d = d.withColumn("__own", own).withColumn("__state", F.when(F.col("__ok"), empty).cast(STATE)).select(*vectors.columns, "__z", "__ok", "__n", "__own", "__state")
    last = None
    for i in range(tiles if size else 0):
        rows = table.where(F.col("tile") == i).drop("tile") if tiles > 1 else table
        rows = rows.toArrow()
        if not rows.num_rows:
            continue
        tile = spark.sparkContext.broadcast(Tile(rows, kind, t, a, loss_temperature, k))
        d = _pass(d, tile, width, k)
        if tiles > 1:
            # Written, so that the tile can go before the next one comes.
            now = kept(d, "states")
            d = now.df
            tile.destroy()
            if last:
                last.drop()
            last = now
    s = F.col("__state")
    top = F.filter(F.arrays_zip(s["ids"].alias("class_idx"), s["best"].alias("score")), lambda x: x["score"] > float("-inf"))
    none = F.expr("CAST(array() AS array<struct<class_idx:bigint,score:double>>)")
    return d.select(
        *vectors.columns, F.col("__own").alias("target_score"), F.when(F.col("__own").isNotNull(), s["above"]).alias("rank"), F.coalesce(top, none).alias("top"),
        (s["high"] + F.log(s["mass"])).alias("log_sum"), s["weight"].alias("weight_sum"), s["weighted"].alias("score_sum"), F.lit(size).cast("long").alias("n_classes"),
    )


def vocabulary_loss(rows: DataFrame, target: str, loss_temperature: float = 1.0, smoothing: float = 0.0, weights: DataFrame | None = None) -> DataFrame:
    """Adds ``loss``, the cross entropy of ``vocabulary_scores`` with the same ``loss_temperature`` and ``weights``; null without a true class.

    As ``scoring.cross_entropy``: ``smoothing`` spreads that share of the target evenly over all classes that have a score,
    each class's term counts by its weight.
    """
    one = weights.select(F.col("class_idx").alias("__c"), F.col("weight").cast("double").alias("__w")) if weights is not None else None
    d = rows.join(one, F.col(target) == F.col("__c"), "left") if one is not None else rows.withColumn("__w", F.lit(1.0))
    hard = F.coalesce("__w", F.lit(1.0)) * (F.col("log_sum") - F.col("target_score") / loss_temperature)
    soft = F.col("log_sum") * F.col("weight_sum") - F.col("score_sum") / loss_temperature
    loss = hard if not smoothing else hard * (1 - smoothing) + soft / F.col("n_classes") * smoothing
    return d.select(*rows.columns, F.when(F.col("target_score").isNotNull(), loss).alias("loss"))
