"""Toxicity by maximum-scoring segments.

Features are lower-case letter tokens and their four-letter beginnings. Their log-odds between toxic and clean
labelled documents take an informative Dirichlet prior; features with a significant z enter the lexicon. A token
scores its best lexicon weight, any other token a constant below zero. The linear scan of Ruzzo and Tompa gives all
maximal-scoring segments of a document; their extreme-value statistics (Karlin and Altschul: lambda from the clean
documents' token scores) give E-values. The significant passages of a document count together, by the statistics of
sums of segment scores; a Gumbel curve fitted on training documents turns that evidence into a score.

The feature counts cover all labelled training documents of different text. A feature needs two of the toxic ones and
significance, no share of the documents: the driver and the workers hold all features that are significant. The
curve's two parameters are fitted on at most ``FIT_ROWS`` training rows.

Defined results: null and empty texts have no passages and the least score; a table without both classes gives every
document 0; rows that repeat are scored each; labels of null doc_id or null value are not used, of several labels of an
id the highest is; empty tables give empty ones; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import held_out, least_hashed, stored, with_only

TOKEN = re.compile(r"[^\W\d_]+")
#: Prior mass, least z and log-odds of a lexicon feature.
PRIOR, LEAST_Z, LEAST_ODDS = 50.0, 3.0, 2.0
#: Score of other tokens, E-value of a significant passage, rows that the curve is fitted on.
OTHER, MOST_E, FIT_ROWS = -0.5, 0.01, 20_000
HEAD = 4
#: Features that a task counts before it gives them out, rows that are worked on at once.
FLUSH, ROWS = 150_000, 200


@dataclass
class ToxicModel:
    words: dict[str, float]
    heads: dict[str, float]
    lam: float
    slope: float
    shift: float


def segments(scores: list[tuple[int, float]], other: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (Ruzzo and Tompa) of n tokens: those listed score above 0, all others ``other`` < 0."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total, at = 0.0, 0
    for pos, s in scores:
        total += other * (pos - at)
        at = pos + 1
        start, left, right = pos, total, total + s
        total = right
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, pos + 1, left, right))
    return [(a, b, r - l) for a, b, l, r in stack]


def scan(text: str | None, m: ToxicModel) -> tuple[int, list[tuple[int, float, int, int]]]:
    """Number of tokens, and lexicon hits as (token, weight, start, end)."""
    hits, n = [], 0
    words, heads = m.words, m.heads
    for n, t in enumerate(TOKEN.finditer((text or "").lower()), 1):  # noqa: B007
        w = t.group()
        s = words.get(w)
        h = heads.get(w[:HEAD])
        if s is not None or h is not None:
            hits.append((n - 1, max(s or 0.0, h or 0.0), t.start(), t.end()))
    return n, hits


def together(n: int, scores: list[float], lam: float) -> float:
    """Evidence, -ln of a probability by chance, of a document of n tokens with segments of these scores.

    A segment alone: lambda * S - ln n. The r best significant ones with the sum T of that: about
    exp(-T) T^(r-1) / (r! (r-1)!), halved for each r tried. -ln n - 1 without a segment.
    """
    length = math.log(max(n, 1))
    own = sorted((lam * s - length for s in scores), reverse=True)
    if not own:
        return -1.0 - length
    best, total = own[0], own[0]
    for r, x in enumerate(own[1:], 2):
        if x < -math.log(MOST_E):
            break
        total += x
        best = max(best, total - (r - 1) * (math.log(total) + math.log(2)) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def curve(x: np.ndarray, slope: float, shift: float) -> np.ndarray:
    """Gumbel distribution function."""
    return np.exp(-np.exp(-np.clip(slope * x + shift, -6, 30)))


def _training(docs: DataFrame, labels: DataFrame):
    """Stored (doc_id, h, toxic) of the training fold, one row for equal texts, h the text's MD5; no text is exchanged."""
    lab = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = _keyed(docs).where(~held_out()).where("text IS NOT NULL").select("doc_id", "h").join(lab, "doc_id")
    return stored(ids.groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("k")).select("k.doc_id", "h", "k.toxic"), "toxic-ids")


def _keyed(docs: DataFrame) -> DataFrame:
    return with_only(docs, "doc_id", "text").withColumn("h", F.md5("text"))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel | None:
    ids = _training(docs, labels)
    train = _keyed(docs).join(ids.df, ["doc_id", "h"]).select("text", "toxic")

    def count(batches):
        seen: list[Counter] = [Counter(), Counter()]

        def give():
            rows = [(f, c, k) for c in (0, 1) for f, k in seen[c].items()]
            for i in range(0, len(rows), 50_000):
                part = rows[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.int64())], ["f", "c", "n"])
            seen[0].clear()
            seen[1].clear()

        for batch in _slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                tokens = TOKEN.findall(text.lower())
                have = set(tokens)
                bag = seen[int(toxic > 0)]
                bag.update(have)
                bag.update({"^" + w[:HEAD] for w in have if len(w) > HEAD})
                bag["$docs"] += 1
                bag["$tokens"] += len(tokens)
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield from give()
        yield from give()

    pair = train.mapInArrow(count, "f string, c int, n long").groupBy("f").agg(F.sum(F.when(F.col("c") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("c") == 0, F.col("n")).otherwise(0)).alias("b"))
    table = stored(pair, "toxic-counts")
    total = {r.f: (r.a, r.b) for r in table.df.where("f IN ('$docs', '$tokens')").collect()}
    n1, n0 = total.get("$docs", (0, 0))
    if not n1 or not n0:
        table.drop()
        ids.drop()
        return None
    prior = F.col("n") * PRIOR / (n1 + n0) + 0.01
    a, b = F.col("a") + F.col("p"), F.col("b") + F.col("p")
    odds = F.log(a / (n1 + PRIOR + 0.02 - a)) - F.log(b / (n0 + PRIOR + 0.02 - b))
    rows = (
        table.df.where("f NOT IN ('$docs', '$tokens')").withColumn("n", F.col("a") + F.col("b")).withColumn("p", prior)
        .withColumns({"odds": odds, "z": odds / F.sqrt(1 / a + 1 / b)})
        .where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS) & (F.col("a") >= 2))
        .select("f", "odds", "b").collect()
    )
    table.drop()
    words = {r.f: r.odds for r in rows if not r.f.startswith("^")}
    heads = {r.f[1:]: r.odds for r in rows if r.f.startswith("^")}
    if not rows:
        ids.drop()
        return None
    # Lambda: the clean documents' expected exp(lambda * score) is 1; a feature never seen there counts half.
    t0 = max(total["$tokens"][1], 1)
    p = np.array([(r.b + 0.5) / t0 for r in rows])
    p *= min(1.0, 0.2 / p.sum())
    s = np.array([r.odds for r in rows])
    if (p * s).sum() + (1 - p.sum()) * OTHER >= 0:
        p *= 0.5 * abs(OTHER) / ((p * s).sum() + p.sum() * abs(OTHER))
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 600))).sum() + (1 - p.sum()) * math.exp(mid * OTHER) < 1 else (lo, mid)
    m = ToxicModel(words, heads, lo, 1.0, 0.0)
    # At most FIT_ROWS ids go to every worker; texts stay where they are.
    sample = F.broadcast(least_hashed(ids.df, FIT_ROWS, "doc_id", "h"))
    got = evidence(_keyed(docs).join(sample, ["doc_id", "h"]), m, "toxic").select("x", "toxic").toPandas()
    ids.drop()
    m.slope, m.shift = _gumbel(got["x"].to_numpy(float), (got["toxic"] > 0).to_numpy())
    return m


def _gumbel(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Most likely slope (>= 0.05) and shift of the curve, by narrowing a grid; fixed and deterministic."""
    best, span = (1.0, 0.0), (3.0, 12.0)
    for _ in range(8):
        grid = [(max(0.05, best[0] + span[0] * i / 6), best[1] + span[1] * j / 6) for i in range(-6, 7) for j in range(-6, 7)]
        loss = []
        for g in grid:
            p = np.clip(curve(x, *g), 1e-9, 1 - 1e-9)
            loss.append(-(np.log(p[y]).sum() + np.log(1 - p[~y]).sum()))
        best = grid[int(np.argmin(loss))]
        span = (span[0] / 2, span[1] / 2)
    return best


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def judged(text: str | None, m: ToxicModel) -> tuple[float, list[dict]]:
    """Evidence of a text, and its significant passages."""
    n, hits = scan(text, m)
    segs = segments([h[:2] for h in hits], OTHER, n)
    start, end = {h[0]: h[2] for h in hits}, {h[0] + 1: h[3] for h in hits}
    e = [(a, b, s, math.exp(min(700.0, math.log(max(n, 1)) - m.lam * s))) for a, b, s in segs]
    return together(n, [s for _, _, s in segs], m.lam), [{"start": start[a], "end": end[b], "score": s, "e_value": v} for a, b, s, v in e if v <= MOST_E]


def evidence(docs: DataFrame, m: ToxicModel, *keep: str) -> DataFrame:
    """(doc_id, x, passages) and the columns ``keep`` (int); passages: (start, end, score, e_value) in code points of the lower-cased text."""
    shared = docs.sparkSession.sparkContext.broadcast(m)
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in _slices(batches):
            got = [judged(t, model) for t in batch.column("text").to_pylist()]
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], passage), *[batch.column(k).cast(pa.int32()) for k in keep]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "x", "passages", *keep])

    schema = "doc_id long, x double, passages array<struct<start:int,end:int,score:double,e_value:double>>" + "".join(f", {k} int" for k in keep)
    return with_only(docs, "doc_id", "text", *keep).mapInArrow(run, schema)


def score(docs: DataFrame, m: ToxicModel | None) -> DataFrame:
    """(doc_id, score, passages) of every document."""
    if m is None:
        return with_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.expr("CAST(array() AS array<struct<start:int,end:int,score:double,e_value:double>>)").alias("passages"))
    inner = F.greatest(F.lit(-6.0), F.least(F.lit(30.0), F.col("x") * m.slope + m.shift))
    return evidence(docs, m).select("doc_id", F.exp(-F.exp(-inner)).alias("score"), "passages")


def accepted(docs: DataFrame, m: ToxicModel | None, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``most``; each row is judged by its own text, without an exchange."""
    if m is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        model = shared.value
        for batch in _slices(batches):
            x = np.array([judged(t, model)[0] for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(curve(x, model.slope, model.shift) < most))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labelled documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, m).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
