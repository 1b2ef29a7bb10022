"""Training of category heads: gradients summed over the cluster, AdamW on the driver, best epoch kept.

A head scores the classes from a projection of the region vector: ``cosine`` against text prototypes over a learned
temperature, ``linear``, ``margin`` (cosine with an angular or cosine margin at the target class while training), or
``hybrid``, a learned mix of an open branch (cosine or margin) and a linear branch with a projection of its own. An
auxiliary output tells countable regions from others. The loss is the weighted cross entropy (or focal loss), plus the
count and alignment losses by their weights; a row weighs purity times valid.

Each step is one pass over the rows of its batch: a task adds up the gradients of its rows, blocks of them are summed on
the cluster, and the driver, which holds weights and AdamW's moments alone, takes the step. Rows are dealt to batches by
a hash of their id, stored by batch, so a step reads its batch only. The state after each epoch is a table in a folder,
from which a broken run goes on to the same result.

Defined results: rows without weight don't count, also those with null fields; a class below 0 stands for class 0 (such
rows have weight 0); a class outside the prototypes raises ValueError, as do weights beyond ``MOST_WEIGHTS``. An epoch
without rows changes nothing and has no losses. The best epoch is the first with the highest validation accuracy;
without validation rows the last one counts.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.operators.sums import summed
from dotloom.sources.store import scratch

#: Bytes of a head's weights that the driver and each task may hold; bytes of scores worked on at once.
MOST_WEIGHTS, SLICE_BYTES = 512_000_000, 32_000_000
#: AdamW's decay of the moments and its floor under the root; bounds of the temperature and of a margin's cosine.
BETAS, EPS, TEMPERATURE, EDGE = (0.9, 0.999), 1e-8, (0.01, 0.5), 1 - 1e-6


@dataclass(frozen=True)
class Config:
    """What is trained and how; ``layers`` 0 scores the region vector itself."""

    head: str = "hybrid"
    proj_dim: int = 512
    layers: int = 2
    dropout: float = 0.0
    open_branch: str = "cosine"
    closed_classes: int | None = None
    temperature: float = 0.07
    scale: float = 30.0
    margin: float = 0.2
    margin_type: str = "arc"
    alpha: float = 0.5
    epochs: int = 40
    batches: int = 1
    lr: float = 1e-3
    weight_decay: float = 1e-4
    warmup: int = 0
    patience: int = 0
    focal_gamma: float | None = None
    lambda_count: float = 0.5
    lambda_align: float = 0.1
    align_temperature: float = 0.07
    smoothing: float = 0.0
    seed: int = 0

    def __post_init__(self):
        if self.head not in ("cosine", "linear", "margin", "hybrid"):
            raise ValueError(f"unknown head {self.head!r}")
        if self.open_branch not in ("cosine", "margin") or self.margin_type not in ("arc", "cos"):
            raise ValueError(f"unknown branch {self.open_branch!r} or margin {self.margin_type!r}")

    def branches(self) -> list[tuple[str, str, bool]]:
        """(prefix of the weights' names, kind, whether the projection is normalised) of each branch, that of the auxiliary output first."""
        if self.head == "hybrid":
            return [("open_head.", self.open_branch, True), ("closed_head.", "linear", False)]
        return [("", self.head, self.head != "linear")]


# ---------------------------------------------------------------- weights
def initial(config: Config, dim: int, classes: int) -> dict[str, np.ndarray]:
    """Fresh weights by name, uniform within one over the root of the inputs."""
    rng, out = np.random.default_rng(config.seed), {}

    def linear(name, n_in, n_out):
        edge = 1 / math.sqrt(n_in)
        out[f"{name}.weight"], out[f"{name}.bias"] = rng.uniform(-edge, edge, (n_out, n_in)), rng.uniform(-edge, edge, n_out)

    wide = config.proj_dim if config.layers else dim
    for prefix, kind, _ in config.branches():
        for i in range(config.layers):
            # A layer's place in the projection counts the activation and the dropout behind it.
            linear(f"{prefix}proj.mlp.{i * (3 if config.dropout else 2)}", dim if i == 0 else config.proj_dim, config.proj_dim)
        if kind == "linear":
            linear(f"{prefix}classifier", wide, config.closed_classes or classes if prefix else classes)
        elif kind == "cosine":
            out[f"{prefix}log_temperature"] = np.array(math.log(config.temperature))
    if config.head == "hybrid":
        out["alpha_logit"] = np.array(math.log(config.alpha / (1 - config.alpha)))
    linear("aux.is_countable", wide, 1)
    return out


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(v) for v in weights.values()])


def shaped(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A flat vector as weights of the names and shapes of ``like``."""
    out, at = {}, 0
    for name, v in like.items():
        out[name] = vector[at : at + np.size(v)].reshape(np.shape(v))
        at += np.size(v)
    return out


# ---------------------------------------------------------------- forward and backward
_erf = np.frompyfunc(math.erf, 1, 1)


def _gelu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact GELU and its slope."""
    part = 0.5 * (1 + _erf(a / math.sqrt(2)).astype(float))
    return a * part, part + a * np.exp(-0.5 * a * a) / math.sqrt(2 * math.pi)


def _dropped(ids: np.ndarray, width: int, layer: int, step: int, share: float) -> np.ndarray:
    """Factors of units that stay (1 / (1 - share)) or go (0), by a hash of row, unit, layer and step, so that a pass done again drops the same."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64)[None] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64((step * 1009 + layer) * 0x165667B19E3779F9 % (1 << 64))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.where((x >> np.uint64(11)).astype(float) / (1 << 53) >= share, 1 / (1 - share), 0.0)


class _Projection:
    """The projection of one branch, with what its backward pass needs."""

    def __init__(self, w: dict, prefix: str, config: Config, normalise: bool, z: np.ndarray, ids=None, step: int | None = None):
        self.w, self.prefix, self.config, self.normalise, self.steps = w, prefix, config, normalise, []
        x = z
        for i in range(config.layers):
            name = f"{prefix}proj.mlp.{i * (3 if config.dropout else 2)}"
            a = x @ w[f"{name}.weight"].T + w[f"{name}.bias"]
            slope = None
            out = a
            if i < config.layers - 1:
                out, slope = _gelu(a)
                if config.dropout and step is not None:
                    keep = _dropped(ids, a.shape[1], i + 100 * len(prefix), step, config.dropout)
                    out, slope = out * keep, slope * keep
            self.steps.append((name, x, slope))
            x = out
        self.raw = x
        self.size = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if normalise else None
        self.h = x / self.size if normalise else x

    def backward(self, dh: np.ndarray, grads: dict) -> None:
        d = (dh - self.h * (self.h * dh).sum(axis=1, keepdims=True)) / self.size if self.normalise else dh
        for name, x, slope in reversed(self.steps):
            if slope is not None:
                d = d * slope
            grads[f"{name}.weight"] += d.T @ x
            grads[f"{name}.bias"] += d.sum(axis=0)
            d = d @ self.w[f"{name}.weight"]


def _unit(t: np.ndarray) -> np.ndarray:
    return t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)


class _Branch:
    """Scores of one branch and their backward pass."""

    def __init__(self, w, prefix, kind, config, p: _Projection, unit, y=None):
        self.w, self.prefix, self.kind, self.p, self.unit = w, prefix, kind, p, unit
        if kind == "linear":
            self.scores = p.h @ w[f"{prefix}classifier.weight"].T + w[f"{prefix}classifier.bias"]
            return
        cos = p.h @ unit.T
        if kind == "cosine":
            t = math.exp(float(w[f"{prefix}log_temperature"]))
            self.factor = 1 / min(max(t, TEMPERATURE[0]), TEMPERATURE[1])
            self.free = TEMPERATURE[0] <= t <= TEMPERATURE[1]
            self.scores = cos * self.factor
            return
        c = np.clip(cos, -EDGE, EDGE)
        self.slope, out = np.where((cos >= -EDGE) & (cos <= EDGE), config.scale, 0.0), c
        if y is not None:
            at = np.arange(len(y)), y
            out = c.copy()
            if config.margin_type == "arc":
                theta = np.arccos(c[at])
                out[at] = np.cos(theta + config.margin)
                self.slope[at] *= np.sin(theta + config.margin) / np.sqrt(1 - c[at] ** 2)
            else:
                out[at] -= config.margin
        self.scores = config.scale * out

    def backward(self, d: np.ndarray, grads: dict) -> np.ndarray:
        """Adds the gradients of the scores' own weights; the gradient of the projection."""
        if self.kind == "linear":
            grads[f"{self.prefix}classifier.weight"] += d.T @ self.p.h
            grads[f"{self.prefix}classifier.bias"] += d.sum(axis=0)
            return d @ self.w[f"{self.prefix}classifier.weight"]
        if self.kind == "cosine":
            if self.free:
                grads[f"{self.prefix}log_temperature"] -= (d * self.scores).sum()
            return d @ self.unit * self.factor
        return (d * self.slope) @ self.unit


def _scored(w: dict, config: Config, unit: np.ndarray, z: np.ndarray, y=None, ids=None, step=None):
    """Branches, the share of the open one, and the scores of all classes."""
    branches = [_Branch(w, prefix, kind, config, _Projection(w, prefix, config, norm, z, ids, step), unit, y) for prefix, kind, norm in config.branches()]
    if config.head != "hybrid":
        return branches, 1.0, branches[0].scores
    a = 1 / (1 + math.exp(-float(w["alpha_logit"])))
    scores = a * branches[0].scores
    scores[:, : branches[1].scores.shape[1]] += (1 - a) * branches[1].scores
    return branches, a, scores


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = x.max(axis=1, keepdims=True)
    e = np.exp(x - top)
    s = e.sum(axis=1, keepdims=True)
    return x - top - np.log(s), e / s


def gradients(w: dict, config: Config, prototypes: np.ndarray, z, y, weight, countable, class_weight=None, ids=None, step: int | None = 0):
    """Sums over rows, not yet over the sum of weights: (weights, class, count, align loss) and the gradients of the total by name."""
    unit, n = _unit(prototypes), len(y)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    branches, a, scores = _scored(w, config, unit, z, y, ids, step)
    classes, at = scores.shape[1], (np.arange(n), y)
    cw = np.ones(classes) if class_weight is None else class_weight
    logp, p = _softmax(scores)
    own, col = logp[at], weight[:, None]
    if config.focal_gamma is not None:
        g, q = config.focal_gamma, np.exp(own)
        losses = -((1 - q) ** g) * own * cw[y]
        slope = (g * (1 - q) ** (g - 1) * q * own - (1 - q) ** g) * cw[y]
        d = -slope[:, None] * p
        d[at] += slope
    else:
        eps = config.smoothing
        losses = -(1 - eps) * cw[y] * own - eps / classes * (logp @ cw)
        d = ((1 - eps) * cw[y] + eps / classes * cw.sum())[:, None] * p - eps / classes * cw
        d[at] -= (1 - eps) * cw[y]
    d *= col
    first = branches[0]
    if config.head == "hybrid":
        closed = branches[1].scores.shape[1]
        grads["alpha_logit"] += a * (1 - a) * ((d * first.scores).sum() - (d[:, :closed] * branches[1].scores).sum())
        branches[1].p.backward(branches[1].backward((1 - a) * d[:, :closed], grads), grads)
    dh = first.backward(a * d, grads)
    # The auxiliary output and the alignment share the first branch's projection.
    h = first.p.h
    s = h @ w["aux.is_countable.weight"][0] + w["aux.is_countable.bias"][0]
    count = np.maximum(s, 0) - s * countable + np.log1p(np.exp(-np.abs(s)))
    ds = config.lambda_count * weight * (np.exp(-np.logaddexp(0, -s)) - countable)
    grads["aux.is_countable.weight"] += ds[None] @ h
    grads["aux.is_countable.bias"] += ds.sum()
    dh = dh + ds[:, None] * w["aux.is_countable.weight"]
    align = np.zeros(n)
    if config.lambda_align > 0:
        size = np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
        u = h / size
        logp, p = _softmax(u @ unit.T / config.align_temperature)
        align = -logp[at]
        p[at] -= 1
        du = config.lambda_align / config.align_temperature * (p * col) @ unit
        dh = dh + (du - u * (u * du).sum(axis=1, keepdims=True)) / size
    first.p.backward(dh, grads)
    sums = np.array([weight.sum(), (weight * losses).sum(), (weight * count).sum(), (weight * align).sum()])
    return sums, grads


# ---------------------------------------------------------------- tables
def prepared(rows: DataFrame, batches: int = 1, seed: int = 0) -> DataFrame:
    """(cand_id, z, y, weight, countable, valid, batch) of rows (cand_id, z, matched_class, purity, valid, is_countable)."""
    d = rows.select(
        F.col("cand_id").cast("long").alias("cand_id"), F.col("z").cast("array<double>").alias("z"), F.greatest(F.col("matched_class").cast("long"), F.lit(0)).alias("y"),
        F.coalesce(F.col("purity").cast("double") * F.col("valid").cast("double"), F.lit(0.0)).alias("weight"), F.coalesce(F.col("is_countable").cast("double"), F.lit(0.0)).alias("countable"), (F.coalesce(F.col("valid"), F.lit(0)) > 0).alias("valid"),
    )
    return d.where(F.col("z").isNotNull() & F.col("y").isNotNull()).withColumn("batch", F.pmod(F.xxhash64("cand_id", F.lit(seed)), F.lit(batches)).cast("int"))


def class_weights(rows: DataFrame, classes: int) -> np.ndarray:
    """Inverse frequency of each class among the valid rows of ``prepared``, at least one each, with mean 1."""
    n = np.ones(classes)
    for r in rows.where(F.col("valid") & F.col("y").between(0, classes - 1)).groupBy("y").agg(F.count("*").alias("n")).collect():
        n[r.y] = max(r.n, 1)
    w = n.sum() / (classes * n)
    return w / w.mean()


def prototype_matrix(prototypes: DataFrame) -> np.ndarray:
    """The table (class_idx, unit), class_idx from 0 without gaps, as a matrix. Raises ValueError for gaps and beyond MOST_WEIGHTS bytes."""
    s = prototypes.agg(F.count("*").alias("n"), F.max(F.size("unit")).alias("d"), F.min("class_idx").alias("a"), F.max("class_idx").alias("z"), F.count_distinct("class_idx").alias("k")).first()
    if not s.n or s.a != 0 or s.z != s.n - 1 or s.k != s.n:
        raise ValueError("prototypes need class_idx 0, 1, ... once each")
    if s.n * s.d * 8 > MOST_WEIGHTS:
        raise ValueError(f"prototypes beyond {MOST_WEIGHTS} bytes")
    return np.array([r.unit for r in prototypes.select("class_idx", F.col("unit").cast("array<double>").alias("unit")).orderBy("class_idx").collect()], float)


def _arrays(batch: pa.RecordBatch, classes: int):
    """Slices of a batch as arrays, so many rows that their scores stay below SLICE_BYTES."""
    step = max(1, SLICE_BYTES // (8 * max(classes, 1)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        z = part.column("z").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        yield (part.column("cand_id").fill_null(0).to_numpy(), z, *[part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "countable", "valid")])


def batch_gradient(rows: DataFrame, w: dict, config: Config, prototypes: np.ndarray, class_weight=None, step: int = 0):
    """(gradient of the batch's mean loss by name, losses by name, sum of weights) in one pass; none for a batch without rows."""
    shared = rows.sparkSession.sparkContext.broadcast((w, prototypes, class_weight))

    def partial(batches):
        w, prototypes, cw = shared.value
        total = None
        for batch in batches:
            for ids, z, y, weight, countable, _ in _arrays(batch, len(prototypes)):
                if y.max(initial=0) >= len(prototypes):
                    raise ValueError(f"class {y.max()} has no prototype")
                sums, grads = gradients(w, config, prototypes, z, y, weight, countable, cw, ids, step)
                part = np.concatenate([sums, flat(grads)])
                total = part if total is None else total + part
        return total

    got = summed(rows.where("weight > 0"), partial)
    shared.unpersist()
    if got is None:
        return None
    weight = max(got[0], 1e-6)
    cls, count, align = got[1:4] / weight
    losses = {"L_cls": cls, "L_count": count, "L_align": align, "L_total": cls + config.lambda_count * count + config.lambda_align * align}
    return shaped(got[4:] / weight, w), losses, float(got[0])


def evaluated(rows: DataFrame, w: dict, config: Config, prototypes: np.ndarray) -> dict[str, float]:
    """Accuracy of the class and of ``countable`` over the valid rows, scored without margin."""
    shared = rows.sparkSession.sparkContext.broadcast((w, prototypes))

    def partial(batches):
        w, prototypes = shared.value
        unit, total = _unit(prototypes), np.zeros(3)
        for batch in batches:
            for _, z, y, _, countable, _ in _arrays(batch, len(prototypes)):
                branches, _, scores = _scored(w, config, unit, z)
                s = branches[0].p.h @ w["aux.is_countable.weight"][0] + w["aux.is_countable.bias"][0]
                total += [len(y), (scores.argmax(axis=1) == y).sum(), ((s > 0) == countable).sum()]
        return total

    got = summed(rows.where("valid"), partial)
    shared.unpersist()
    n, top, count = got if got is not None else (0, 0, 0)
    return {"eval_top1": float(top / max(n, 1)), "eval_countable_acc": float(count / max(n, 1)), "eval_n_valid": float(n)}


def scores(rows: DataFrame, trained: Trained, prototypes: np.ndarray) -> DataFrame:
    """(cand_id, class_idx, logit, countable_logit): the best class of each row (cand_id, z), the lowest among equals."""
    shared, config = rows.sparkSession.sparkContext.broadcast((trained.weights, prototypes)), trained.config

    def run(batches):
        w, prototypes = shared.value
        unit, step = _unit(prototypes), max(1, SLICE_BYTES // (8 * len(prototypes)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                z = part.column("z").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                branches, _, x = _scored(w, config, unit, z)
                s = branches[0].p.h @ w["aux.is_countable.weight"][0] + w["aux.is_countable.bias"][0]
                best = x.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("cand_id"), pa.array(best), pa.array(x[np.arange(len(x)), best]), pa.array(s)], ["cand_id", "class_idx", "logit", "countable_logit"])

    d = rows.select(F.col("cand_id").cast("long").alias("cand_id"), F.col("z").cast("array<double>").alias("z")).where("z IS NOT NULL")
    return d.mapInArrow(run, "cand_id long, class_idx long, logit double, countable_logit double")


# ---------------------------------------------------------------- the loop
def rate_factor(config: Config, epoch: int) -> float:
    """Linear warm-up, then half a cosine; epochs count from 0."""
    if config.warmup > 0 and epoch < config.warmup:
        return (epoch + 1) / config.warmup
    return 0.5 * (1 + math.cos(math.pi * min(1.0, (epoch - config.warmup) / max(1, config.epochs - config.warmup))))


@dataclass
class State:
    """All that a run needs to go on: weights, moments, steps taken, and the best epoch so far."""

    weights: dict[str, np.ndarray]
    mean: dict[str, np.ndarray]
    square: dict[str, np.ndarray]
    steps: int = 0
    epoch: int = 0
    best: dict[str, np.ndarray] | None = None
    best_epoch: int = 0
    best_metric: float = -1.0
    stale: int = 0
    history: list[dict] = field(default_factory=list)

    def step(self, grads: dict[str, np.ndarray], lr: float, decay: float) -> None:
        """One step of AdamW."""
        self.steps += 1
        (b1, b2), t = BETAS, self.steps
        for k, g in grads.items():
            self.mean[k] = b1 * self.mean[k] + (1 - b1) * g
            self.square[k] = b2 * self.square[k] + (1 - b2) * g * g
            move = self.mean[k] / (1 - b1**t) / (np.sqrt(self.square[k] / (1 - b2**t)) + EPS)
            self.weights[k] = self.weights[k] * (1 - lr * decay) - lr * move


STATE = "part string, place int, name string, shape array<int>, block int, vals array<double>"


def write_state(spark: SparkSession, state: State, path: str, block: int = 1 << 16) -> None:
    """The state as a table of blocks of numbers, and one JSON row of the rest, written last."""
    rows = []
    for part in ("weights", "mean", "square", "best"):
        for place, (name, v) in enumerate((getattr(state, part) or {}).items()):
            for b, at in enumerate(range(0, np.size(v), block)):
                rows.append((part, place, name, list(np.shape(v)), b, np.ravel(v)[at : at + block].tolist()))
    spark.createDataFrame(rows, STATE).coalesce(4).write.mode("overwrite").parquet(f"{path}/numbers")
    rest = {k: getattr(state, k) for k in ("steps", "epoch", "best_epoch", "best_metric", "stale", "history")}
    spark.createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rest")


def read_state(spark: SparkSession, path: str) -> State:
    parts: dict[str, dict] = {p: {} for p in ("weights", "mean", "square", "best")}
    for r in spark.read.schema(STATE).parquet(f"{path}/numbers").orderBy("part", "place", "block").collect():
        parts[r.part].setdefault(r.name, (r["shape"], []))[1].extend(r.vals)
    numbers = {p: {k: np.array(v, float).reshape(s) for k, (s, v) in d.items()} for p, d in parts.items()}
    return State(**{**numbers, "best": numbers["best"] or None}, **json.loads(spark.read.text(f"{path}/rest").first().value))


def _epochs_in(spark: SparkSession, path: str) -> list[int]:
    """The epochs whose state in a folder is whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[6:]) for n in names if n.startswith("epoch-") and fs.exists(hadoop.Path(f"{path}/{n}/rest/_SUCCESS")))


@dataclass
class Trained:
    """The weights of the best epoch, or of the last without validation, and the epochs' losses and measures."""

    config: Config
    weights: dict[str, np.ndarray]
    epoch: int
    history: list[dict]

    def history_table(self, spark: SparkSession) -> DataFrame:
        names = ["L_cls", "L_count", "L_align", "L_total", "eval_top1", "eval_countable_acc", "eval_n_valid"]
        rows = [(h["epoch"], h["lr"], *[h.get(n) for n in names], h["best"]) for h in self.history]
        return spark.createDataFrame(rows, "epoch long, lr double, " + ", ".join(f"{n} double" for n in names) + ", best boolean")

    def linear_table(self, spark: SparkSession) -> DataFrame:
        """(class_idx, w, b) of the linear branch."""
        p = "closed_head." if self.config.head == "hybrid" else ""
        w, b = self.weights[f"{p}classifier.weight"], self.weights[f"{p}classifier.bias"]
        return spark.createDataFrame([(c, w[c].tolist(), float(b[c])) for c in range(len(b))], "class_idx long, w array<double>, b double")

    def write(self, spark: SparkSession, path: str) -> None:
        """The checkpoint: weights, configuration, epoch and its measures."""
        write_state(spark, State(self.weights, {}, {}, epoch=self.epoch, history=[{"config": asdict(self.config), "history": self.history}]), path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Trained:
        s = read_state(spark, path)
        return Trained(Config(**s.history[0]["config"]), s.weights, s.epoch, s.history[0]["history"])


def train(rows: DataFrame, prototypes: DataFrame | np.ndarray, config: Config, validation: DataFrame | None = None, class_weight: np.ndarray | str | None = None, weights: dict | None = None, folder: str | None = None) -> Trained:
    """Trains a head on rows (cand_id, z, matched_class, purity, valid, is_countable) and prototypes (class_idx, unit).

    ``class_weight`` "balanced" weighs classes by ``class_weights``. ``weights`` are the first ones, else ``initial``.
    With ``folder`` each epoch's state is written there (the last two stay), and a run goes on from the last whole one.
    """
    spark, t = rows.sparkSession, prototypes if isinstance(prototypes, np.ndarray) else prototype_matrix(prototypes)
    path = scratch(spark, "training")
    prepared(rows, config.batches, config.seed).write.partitionBy("batch").parquet(f"{path}/rows")
    data = spark.read.schema("cand_id long, z array<double>, y long, weight double, countable double, valid boolean, batch int").parquet(f"{path}/rows")
    held = prepared(validation) if validation is not None else None
    if held is not None:
        held.write.parquet(f"{path}/held")
        held = spark.read.schema(held.schema).parquet(f"{path}/held")
    if weights is None:
        size = data.select(F.size("z").alias("d")).first()
        weights = initial(config, size.d if size else t.shape[1], len(t))
    if sum(np.size(v) for v in weights.values()) * 8 > MOST_WEIGHTS:
        raise ValueError(f"weights beyond {MOST_WEIGHTS} bytes")
    if isinstance(class_weight, str):
        class_weight = class_weights(data, len(t))
    zero = {k: np.zeros_like(v, dtype=float) for k, v in weights.items()}
    state = State({k: np.array(v, float) for k, v in weights.items()}, dict(zero), dict(zero))
    if folder and (done := _epochs_in(spark, folder)):
        state = read_state(spark, f"{folder}/epoch-{done[-1]}")
    while state.epoch < config.epochs and not (config.patience > 0 and held is not None and state.stale >= config.patience):
        _epoch(state, data, held, t, config, class_weight)
        if folder:
            write_state(spark, state, f"{folder}/epoch-{state.epoch}")
            _forget(spark, folder, keep=2)
    _forget(spark, path, keep=0)
    best = state.best is not None
    return Trained(config, state.best if best else state.weights, state.best_epoch if best else state.epoch, state.history)


def _epoch(state: State, data: DataFrame, held: DataFrame | None, t: np.ndarray, config: Config, class_weight) -> None:
    """One epoch: a step for each batch, in an order of the epoch's own, then the validation."""
    lr, means = config.lr * rate_factor(config, state.epoch), []
    for b in np.random.default_rng([config.seed, state.epoch]).permutation(config.batches).tolist():
        got = batch_gradient(data.where(F.col("batch") == b), state.weights, config, t, class_weight, state.steps)
        if got:
            state.step(got[0], lr, config.weight_decay)
            means.append(got[1])
    state.epoch += 1
    now = {"epoch": state.epoch, "lr": lr, "best": False, **({k: float(np.mean([m[k] for m in means])) for k in means[0]} if means else {})}
    if held is not None:
        now |= evaluated(held, state.weights, config, t)
        if now["eval_top1"] > state.best_metric:
            state.best_metric, state.stale, state.best_epoch, now["best"] = now["eval_top1"], 0, state.epoch, True
            state.best = {k: v.copy() for k, v in state.weights.items()}
        else:
            state.stale += 1
    state.history.append(now)


def _forget(spark: SparkSession, folder: str, keep: int) -> None:
    """Deletes a folder's states but the last ones; with ``keep`` 0 the folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [folder] if not keep else [f"{folder}/epoch-{e}" for e in _epochs_in(spark, folder)[:-keep]]
    for p in gone:
        fs.delete(hadoop.Path(p), True)
