"""N-gram Jaccard join by MinHash banding.

Sets are the shingles of five consecutive words (a shorter text is one shingle). ``BANDS`` bands of ``ROWS`` MinHash
values are computed for the target recall at the threshold; texts that share a band hash meet in its bucket, and every
pair that meets is verified once on full shingle sets. A bucket of at most ``BUCKET`` texts lists its pairs. A larger
one is split into blocks of about ``BLOCK`` texts, and each block is compared with each: a task holds two blocks, and
gives out numbers of links and a spanning forest of them instead of pairs. A pair that meets in several such buckets is
counted in the one with the least key. Equal texts are one node: its number is the least doc_id, or, where several
texts have that same one, a hash of the text. Classes are the connected components of the links.

Defined results: one row for each row, (doc_id, class_id, n_links): class_id is the least doc_id of the class, n_links
the verified links of its text to other texts (all that share a band). Null and empty texts are equal texts; a text
without words links to equal texts alone; rows of a null doc_id have a null class and no links; rows that share a doc_id
are judged by their own texts; empty tables give empty ones; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import Stored, _splitmix, chunks, components, inside, mix, row_of, span_hashes, stored, text_buffers, window_hashes, with_only, word_hashes, words_of

#: Words of a shingle, least Jaccard similarity, target recall at it, MinHash values of a band.
SHINGLE, LEAST, RECALL, ROWS = 5, 0.8, 0.999, 5
BANDS = math.ceil(math.log(1 - RECALL) / math.log(1 - LEAST**ROWS))
#: Most texts of a bucket that lists its pairs, texts of a block of a larger one, shingles compared at once.
BUCKET, BLOCK, COLUMNS = 16, 512, 4096
SIGNATURE = "doc_id long, h0 long, h1 long, bands array<long>"
KEY = ["h0", "h1"]


def shingles(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, and the offsets of each row's."""
    s, e, word_off = words_of(data, off)
    words = word_hashes(data, s, e)
    ok = np.flatnonzero(inside(word_off, n, len(words)))
    size = np.diff(word_off)
    few = np.flatnonzero((size > 0) & (size < n))
    h = np.concatenate([window_hashes(words, n)[ok], span_hashes(words, word_off[few], word_off[few + 1])])
    row = np.concatenate([row_of(word_off)[ok], few])
    order = np.argsort(row, kind="stable")
    return h[order], np.searchsorted(row[order], np.arange(len(off)))


def band_keys(h: np.ndarray, off: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """bands x rows-with-shingles."""
    heads = off[:-1][off[1:] > off[:-1]]
    a, b = _splitmix(bands * rows, 77) | np.uint64(1), _splitmix(bands * rows, 99)
    keys = np.empty((bands, len(heads)), np.uint64)
    for k in range(bands):
        key = np.full(len(heads), k + 1, np.uint64)
        for j in range(k * rows, (k + 1) * rows):
            key = mix(key ^ np.minimum.reduceat(h * a[j] + b[j], heads))
        keys[k] = key
    return keys


def _md5(text, first: int):
    """Half of a text's MD5 as a long; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), first, 16), 16, -10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h0, h1) of the rows with an id."""
    d = with_only(docs, "doc_id", "text").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumns({"h0": _md5(F.col("text"), 1), "h1": _md5(F.col("text"), 17)})


def signatures(docs: DataFrame) -> DataFrame:
    """Rows of SIGNATURE of ``keyed`` documents."""

    def run(batches):
        for part, data, off in chunks(batches):
            h, s_off = shingles(data, off)
            has = s_off[1:] > s_off[:-1]
            keys = band_keys(h, s_off).T.ravel().view(np.int64) if has.any() else np.zeros(0, np.int64)
            list_off = np.concatenate([[0], np.cumsum(has * BANDS)])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", *KEY)], pa.ListArray.from_arrays(pa.array(list_off, pa.int32()), pa.array(keys))], ["doc_id", *KEY, "bands"])

    return docs.mapInArrow(run, SIGNATURE)


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (u, v) of nodes whose full shingle sets have a Jaccard similarity of at least ``least``."""
    a = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))

    def sets(batch, column, at, n):
        h, off = shingles(*text_buffers(batch.column(column).slice(at, n)))
        return [np.unique(h[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]

    def run(batches):
        for batch in batches:
            ok = []
            for at in range(0, batch.num_rows, 256):
                n = min(256, batch.num_rows - at)
                for x, y in zip(sets(batch, "a", at, n), sets(batch, "b", at, n), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _shared(row: np.ndarray, value: np.ndarray, n: int, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Common distinct values of each of the first ``first`` rows with each from ``second`` on, and the values of each of n rows."""
    _, value = np.unique(value, return_inverse=True)
    width = int(value.max()) + 1 if len(value) else 1
    row, value = np.divmod(np.unique(row * width + value), width)
    size = np.bincount(row, minlength=n)
    # A value of one row alone is common to none.
    often = np.bincount(value, minlength=width) > 1
    row, value = row[often[value]], (np.cumsum(often) - 1)[value[often[value]]]
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    both = np.zeros((first, n - second), np.float32)
    for at in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(value, [at, at + COLUMNS])
        has = np.zeros((n, COLUMNS), np.float32)
        has[row[a:b], value[a:b] - at] = 1
        both += has[:first] @ has[second:].T
    return both, size


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that keep every connected part of a link matrix connected."""
    out, new = [], [np.ones(k, bool) for k in link.shape]
    for start in range(link.shape[0]):
        todo = [(0, start)] if new[0][start] else []
        new[0][start] = False
        while todo:
            side, x = todo.pop()
            for y in np.flatnonzero((link[:, x] if side else link[x]) & new[1 - side]).tolist():
                new[1 - side][y] = False
                out.append((y, x) if side else (x, y))
                todo.append((1 - side, y))
    return out


def compared(t: pa.Table) -> pa.Table:
    """The links of two blocks of a bucket (one block against itself where ``side`` is 0 alone), as in ``links``."""
    t = t.sort_by([("side", "ascending"), ("node", "ascending")]).combine_chunks()
    ids, side, n = t.column("node").to_numpy(), t.column("side").to_numpy(), t.num_rows
    first = int((side == 0).sum())
    second = first if first < n else 0
    h, off = shingles(*text_buffers(t.column("text")))
    both, size = _shared(row_of(off), h, n, first, second)
    link = (both > 0) & (both >= LEAST * (size[:first, None] + size[None, second:] - both) - 1e-9)
    key, keys = t.column("key")[0].as_py(), t.column("big").to_pylist()
    before = [[k for k in x if k < key] for x in keys]
    earlier = _shared(np.repeat(np.arange(n), [len(x) for x in before]), np.array([k for x in before for k in x], np.int64), n, first, second)[0]
    link &= earlier == 0
    if not second:
        np.fill_diagonal(link, False)
    u, v = ids[:first], ids[second:]
    at = [(u, link.sum(axis=1))] + ([(v, link.sum(axis=0))] if second else [])
    if not second:
        np.fill_diagonal(link, link.any(axis=1))
    edges = _forest(link)
    rows = [(int(u[x]), int(v[y]), 0) for x, y in edges if u[x] != v[y]]
    rows += [(int(i), None, int(k)) for who, many in at for i, k in zip(who, many, strict=True) if k]
    return pa.table({"u": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64())})


def nodes(sig: DataFrame) -> Stored:
    """(h0, h1, least, node) of each text: its least doc_id, and its node."""
    texts = stored(sig.groupBy(*KEY).agg(F.min("doc_id").alias("least")), "texts")
    shared = texts.df.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select("least", F.lit(True).alias("shared"))
    out = stored(texts.df.join(shared, "least", "left").select(*KEY, "least", F.when(F.col("shared"), F.xxhash64(*KEY)).otherwise(F.col("least")).alias("node")), "nodes")
    texts.drop()
    return out


def links(docs: DataFrame, sig: DataFrame, node: DataFrame) -> Stored:
    """Verified links between texts: rows (u, v, n) of nodes, n to add to the links of u, and u linked to v unless null."""
    every = stored(sig.join(node.withColumnRenamed("least", "doc_id"), ["doc_id", *KEY]).select(F.explode("bands").alias("key"), "node").distinct(), "bands")
    sizes = every.df.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = stored(every.df.join(sizes, "key"), "met")
    every.drop()
    # A row a node that meets another: rows that repeat an id and a text count once.
    some = node.join(met.df.select("node").distinct(), "node", "left_semi").withColumnRenamed("least", "doc_id")
    texts = stored(docs.join(some, ["doc_id", *KEY]).groupBy("node").agg(F.first("text").alias("text")), "node-texts")
    large = met.df.where(F.col("size") > BUCKET)
    big = stored(large.groupBy("node").agg(F.collect_set("key").alias("big")), "large")
    few = met.df.where(F.col("size") <= BUCKET)
    pairs = few.select("key", F.col("node").alias("u")).join(few.select("key", F.col("node").alias("v")), "key").where("u < v").select("u", "v").distinct()
    # Pairs that meet in a large bucket too are counted there.
    for x in ("u", "v"):
        pairs = pairs.join(big.df.select(F.col("node").alias(x), F.col("big").alias(f"big_{x}")), x, "left")
    pairs = stored(pairs.where("NOT coalesce(arrays_overlap(big_u, big_v), false)").select("u", "v"), "pairs")
    found = stored(verified(pairs.df, texts.df), "links")
    dealt = large.select("key", "node", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(big.df, "node").join(texts.df, "node").withColumn("their", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "their").alias("i"), F.greatest("mine", "their").alias("j"), (F.col("mine") > F.col("their")).cast("int").alias("side"), "node", "text", "big")
    blocked = dealt.groupBy("key", "i", "j").applyInArrow(compared, "u long, v long, n long")
    out = stored(found.df.selectExpr("u", "v", "1L AS n").union(found.df.selectExpr("v", "u", "1L")).union(blocked), "links")
    for t in (met, texts, big, pairs, found):
        t.drop()
    return out


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, h0, h1, class_id, n_links, kept) of every row with an id; ``kept``: its text and id are the least of its class."""
    d = keyed(docs)
    sig = stored(signatures(d), "signatures")
    node = nodes(sig.df)
    found = links(d, sig.df, node.df)
    label = components(found.df.where("v IS NOT NULL").select("u", "v"), "jaccard")
    # The least id of each component, and the least text of that id.
    first = node.df.join(label.df, "node").groupBy("label").agg(F.min(F.struct("least", *KEY)).alias("first"))
    first = label.df.join(first, "label").select("node", "first")
    degree = found.df.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    texts = node.df.join(first, "node", "left").join(degree, "node", "left")
    own = F.coalesce((F.col("first.h0") == F.col("h0")) & (F.col("first.h1") == F.col("h1")), F.lit(True))
    texts = stored(texts.select(*KEY, F.coalesce("first.least", "least").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("own")), "classes")
    for t in (node, found, label):
        t.drop()
    return sig.df.select("doc_id", *KEY).join(texts.df, KEY).select("doc_id", *KEY, "class_id", "n_links", (F.col("own") & (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of every row."""
    none = with_only(docs, "doc_id").where("doc_id IS NULL").selectExpr("CAST(NULL AS long)", "CAST(NULL AS long)", "0L")
    return judged(docs).select("doc_id", "class_id", "n_links").union(none)


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row (all columns) of each class, that of the least doc_id (and the least text of that id); rows of a null doc_id are kept."""
    kept = judged(docs).where("kept").select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", *KEY)]).distinct()
    d = docs.where(docs["doc_id"].isNotNull()).withColumns({"__doc_id": docs["doc_id"].cast("long"), "__h0": _md5(docs["text"], 1), "__h1": _md5(docs["text"], 17)})
    one = d.join(kept, ["__doc_id", "__h0", "__h1"], "left_semi").dropDuplicates(["__doc_id", "__h0", "__h1"])
    return one.select(*docs.columns).union(docs.where(docs["doc_id"].isNull()))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
