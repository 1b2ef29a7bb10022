"""Quality by a sparse rule ensemble.

Statistics of each whole text come from numpy over UTF-8 bytes. Small trees grown on bootstrap samples give
conjunctive rules (their paths); a lasso logistic fit keeps a few; the kept rules are compiled into one Spark column
expression over the statistics.

The trees and the lasso are fitted on at most ``FIT_ROWS`` labelled training rows of different text (least hash of
the id first); scoring covers every row.

Defined results: null and empty texts have zero statistics and are scored like any text; without labelled rows every
score is 0.5; a single class gives that class's smoothed share; repeated rows are scored each; labels of null doc_id
or null value are not used, of several labels of an id the highest is; empty tables give empty ones; further columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import chunks, held_out, inside, least_hashed, row_of, window_hashes, with_only, word_hashes, words_of

#: Labelled rows used for the fit, trees, their depth, least rows of a leaf, strength of the lasso.
FIT_ROWS, TREES, DEPTH, LEAST_LEAF, LASSO = 20_000, 24, 3, 10, 0.002

STATS = ["n_bytes", "n_words", "word_bytes", "longest_word", "upper", "digit", "symbol", "stop", "wide", "lines", "words_a_line", "distinct", "distinct_pairs", "distinct_lines", "short_words"]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars.encode(), np.uint8)] = True
    return t


_UPPER = _table("".join(chr(c) for c in range(65, 91)))
_DIGIT = _table("0123456789")
_SYMBOL = _table("!#$%&*|~^<>{}[]=+@\\/_")
_STOP = _table(".,;:?")
_WIDE = np.arange(256) >= 128
_LINE = np.zeros(256, bool)
_LINE[10] = True


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATS for each text."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    starts, ends, word_off = words_of(data, off)
    words = np.diff(word_off).astype(float)
    length = ends - starts
    row = row_of(word_off)

    def share(table):
        c = np.concatenate([[0], np.cumsum(table[data])])
        return (c[off[1:]] - c[off[:-1]]) / np.maximum(size, 1)

    def distinct(h, r):
        if not len(h):
            return np.ones(n)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
        return np.where(np.bincount(r, minlength=n) > 0, np.bincount(r, weights=new, minlength=n) / np.maximum(np.bincount(r, minlength=n), 1), 1.0)

    h = word_hashes(data, starts, ends)
    ok = np.flatnonzero(inside(word_off, 2, len(starts)))
    ls, le, line_off = words_of(data, off, _LINE)
    lines = np.diff(line_off).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    return np.column_stack([
        size, words, np.bincount(row, weights=length, minlength=n) / np.maximum(words, 1), longest,
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_STOP), share(_WIDE), lines, words / np.maximum(lines, 1),
        distinct(h, row), distinct(window_hashes(h, 2)[ok], row[ok]), distinct(word_hashes(data, ls, le), row_of(line_off)),
        np.bincount(row, weights=length <= 3, minlength=n) / np.maximum(words, 1),
    ])


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, STATS..., keep...) of each whole text; ``keep`` are int columns."""

    def run(batches):
        for part, data, off in chunks(batches):
            s = statistics(data, off)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *[pa.array(s[:, k]) for k in range(len(STATS))], *[part.column(k).cast(pa.int32()) for k in keep]], ["doc_id", *STATS, *keep])

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATS) + "".join(f", {k} int" for k in keep)
    return with_only(docs, "doc_id", "text", *keep).mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound), all of which hold


@dataclass
class QualityModel:
    rules: list[tuple[float, Rule]]
    bias: float


def _split(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
    """The statistic and bound that lower the Gini impurity most."""
    best, out = 1e-9, None
    n, total = len(y), y.sum()
    base = total * (n - total) / n
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, c = x[order, k], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= LEAST_LEAF) & (at <= n - LEAST_LEAF)]
        if not len(at):
            continue
        left = c[at - 1]
        gain = base - left * (at - left) / at - (total - left) * (n - at - total + left) / (n - at)
        j = int(np.argmax(gain))
        if gain[j] > best:
            best, out = gain[j], (k, float((v[at[j] - 1] + v[at[j]]) / 2))
    return out


def _paths(x, y, rng, depth, path=()) -> list[Rule]:
    """The rules of all nodes below the root."""
    rules: list[Rule] = [path] if path else []
    if depth and 0 < y.sum() < len(y):
        some = np.sort(rng.choice(x.shape[1], max(4, x.shape[1] * 2 // 3), replace=False))
        cut = _split(x[:, some], y)
        if cut:
            k, bound = int(some[cut[0]]), cut[1]
            for above in (False, True):
                m = (x[:, k] > bound) == above
                rules += _paths(x[m], y[m], rng, depth - 1, (*path, (k, above, bound)))
    return rules


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for k, above, bound in rule:
        ok &= (x[:, k] > bound) == above
    return ok


def learn(x: np.ndarray, y: np.ndarray, seed: int = 7) -> QualityModel:
    """Rules and weights: accelerated proximal gradient on the logistic loss with an L1 term."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = QualityModel([], math.log(p / (1 - p)))
    if len(set(y.tolist())) < 2:
        return model
    rng = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        pick = rng.integers(0, len(y), min(len(y), 4000))
        rules.update(dict.fromkeys(_paths(x[pick], y[pick].astype(float), rng, DEPTH)))
    names = list(rules)
    if not names:
        return model
    z = np.column_stack([_holds(r, x) for r in names]).astype(float)
    z, where = np.unique(z, axis=1, return_index=True)
    names = [names[i] for i in where]
    step = 4 * len(y) / max(np.linalg.norm(z, 2) ** 2 + len(y), 1.0)
    w, b, v, vb, t = np.zeros(len(names)), model.bias, np.zeros(len(names)), model.bias, 1.0
    for _ in range(600):
        g = (1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30))) - y) / len(y)
        nw = v - step * (z.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * LASSO, 0)
        nb, nt = vb - step * g.sum(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    model.rules = [(float(a), r) for a, r in zip(w, names, strict=True) if abs(a) > 1e-4]
    model.bias = float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """The model of the labelled rows that are not held out; None without any."""
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    lab = least_hashed(lab.where(~held_out()), FIT_ROWS, "doc_id")
    # At most FIT_ROWS ids and labels go to every worker; texts stay where they are.
    rows = with_statistics(with_only(docs, "doc_id", "text").join(F.broadcast(lab), "doc_id"), "quality").toPandas()
    rows = rows.sort_values("doc_id").drop_duplicates(STATS)  # equal texts have equal statistics
    return learn(rows[STATS].to_numpy(float), (rows["quality"] > 0).to_numpy().astype(float)) if len(rows) else None


def compiled(m: QualityModel | None) -> Column:
    """The model as one column expression over STATS."""
    if m is None:
        return F.lit(0.5)
    total = F.lit(m.bias)
    for weight, rule in m.rules:
        cond = F.lit(True)
        for k, above, bound in rule:
            cond = cond & ((F.col(STATS[k]) > bound) if above else (F.col(STATS[k]) <= bound))
        total = total + F.when(cond, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, m: QualityModel | None) -> DataFrame:
    """(doc_id, score, STATS...) of every document."""
    return with_statistics(docs).select("doc_id", compiled(m).alias("score"), *STATS)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labelled documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, m).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
