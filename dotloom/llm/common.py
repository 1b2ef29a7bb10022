"""Helpers that the operators of this subpackage share: storage, Arrow batches, word hashes, components."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy code works on at once. A longer single text is worked on alone.
CHUNK_BYTES = 2_000_000

_M = np.uint64


# ---------------------------------------------------------------- shared storage
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a local session gets a folder of its own, removed at exit; a cluster's folder can't
    be guessed, so there ValueError is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="dotloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``stored`` wrote; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


class Stored:
    """A table written to the shared folder, in folders by column ``by`` if given: ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, spark: SparkSession, df: DataFrame, name: str, by: str | None = None):
        self.spark, self.path = spark, f"{shared_dir(spark)}/dotloom-{name}-{uuid.uuid4().hex}"
        schema = df.schema
        write = df.write.option("compression", "zstd")
        (write.partitionBy(by) if by else write).parquet(self.path)
        self.df = spark.read.schema(schema).parquet(self.path)
        atexit.register(_remove_at_exit, spark, self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def stored(df: DataFrame, name: str, by: str | None = None) -> Stored:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder, so that a lost executor loses nothing."""
    return Stored(df.sparkSession, df, name, by)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the exchange files of tables that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- Arrow batches
def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text (or one row), with bytes and offsets."""
    for batch in batches:
        data, off = text_buffers(batch.column(column))
        start, n = 0, batch.num_rows
        while start < n:
            end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
            end = min(end, n)
            yield batch.slice(start, end - start), data[off[start] : off[end]], off[start : end + 1] - off[start]
            start = end


# ---------------------------------------------------------------- words and hashes
def _splitmix(n: int, seed: int) -> np.ndarray:
    """n well mixed 64-bit numbers of a fixed rule."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_M) * _M(0x9E3779B97F4A7C15) + _M(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
        return x ^ (x >> _M(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_GOLD = _M(0x9E3779B97F4A7C15)
_ODD = (_M(0xD6E8FEB86659FD93), _M(0xA0761D6478BD642F))
_SEED = (11, 23)
#: What is left of eight bytes of which k belong to a span, read as a little-endian number.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _M)
_PLACES: dict[int, np.ndarray] = {}


def _places(which: int, n: int) -> np.ndarray:
    """Random numbers of the first n places in a span."""
    have = _PLACES.get(which)
    if have is None or len(have) < n:
        have = _PLACES[which] = _splitmix(max(n, 1 << 12), _SEED[which])
    return have[:n]


def words_of(data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words (runs of bytes that ``space`` does not mark), and the n+1 offsets of each row's words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    sep = space[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = sep[:-1]
    heads = off[:-1]
    first[heads[heads < n]] = True
    first &= ~sep
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = sep[1:]
    tails = off[1:] - 1
    last[tails[(tails >= 0) & (off[1:] > off[:-1])]] = True
    last &= ~sep
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def _summed(values: np.ndarray, place: np.ndarray, off: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    """Hashes of spans values[off[i]:off[i + 1]] of ``size`` units each: values mixed with their place, summed, mixed with the size."""
    with np.errstate(over="ignore"):
        c = np.zeros(len(values) + 1, _M)
        np.cumsum(mix(values ^ _places(which, int(place.max()) + 1 if len(place) else 0)[place]), out=c[1:])
        return mix(c[off[1:]] - c[off[:-1]] + size.astype(_M) * _GOLD)


def _spread(starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For spans of ``count`` units each: the n+1 offsets of their units, and each unit's span and place in it."""
    off = np.concatenate([[0], np.cumsum(count)])
    span = np.repeat(np.arange(len(starts)), count)
    return off, span, np.arange(off[-1]) - off[span]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of values[starts:ends] for 64-bit values; for spans that overlap little."""
    off, span, place = _spread(starts, ends - starts)
    return _summed(values[starts[span] + place], place, off, ends - starts, which)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of bytes data[starts:ends], eight at a time; ``which`` picks one of two independent hashes."""
    size = ends - starts
    off, span, place = _spread(starts, (size + 7) // 8)
    at = starts[span] + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    return _summed(eight & _MASK[np.minimum(ends[span] - at, 8)], place, off, size, which)


def window_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of every n consecutive word hashes, joined from halves; rows are not kept apart (see ``inside``)."""
    if len(words) < n:
        return np.zeros(0, _M)
    total = len(words) - n + 1
    with np.errstate(over="ignore"):
        part, size, at, out = mix(words ^ _GOLD), 1, 0, None  # part: hashes of ``size`` words from each word on
        while True:
            if n & size:
                mine = part[at : at + total]
                out = mine if out is None else mix(out * _ODD[which] + mine)
                at += size
            if 2 * size > n:
                return out
            part, size = mix(part[:-size] * _ODD[which] + part[size:]), 2 * size


def inside(word_off: np.ndarray, n: int, total: int) -> np.ndarray:
    """Marks window starts, of total - n + 1, whose n words lie in one row."""
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total + 1, bool)
    for k in range(1, n):  # the last n - 1 starts before each row's end are no windows
        at = word_off[1:] - k
        ok[at[at >= 0]] = False
    return ok[: total - n + 1]


def row_of(word_off: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))


def with_only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of any name don't disturb."""
    return df.select(*[df[c] for c in columns])


def least_hashed(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most ``n`` of the rows, a documented sample for a fit: those with the least hash of the columns.

    Rows far above the n-th hash go first, by its expected place, so that no partition sends n rows to one task.
    """
    total, place = rows.count(), F.xxhash64(*columns).bitwiseAND(F.lit((1 << 32) - 1))
    if total > 2 * n:
        rows = rows.where(place < int((1 << 32) * 1.5 * n / total))
    return rows.orderBy(place, *columns).limit(n)


def held_out(column: str = "doc_id"):
    """The evaluation fold: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- components
def components(edges: DataFrame, name: str) -> Stored:
    """Connected components of the edges (u, v), both long: a table (node, label), label the least node.

    Each round takes the least label over a node's neighbours and then follows labels once more (pointer
    jumping), so paths halve. Labels are written to the shared folder each round. Joins meet on a side with one
    row a node, and both sides are stored tables, so that a hot node's rows can be split by adaptive execution.
    Labels only fall, so the rounds end. An empty edge table gives an empty table.
    """
    both = stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), f"{name}-edges")
    labels = stored(both.df.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-labels")
    while True:
        at = labels.df.select(F.col("node").alias("v"), F.col("label").alias("theirs"))
        near = stored(both.df.join(at, "v").groupBy(F.col("u").alias("node")).agg(F.min("theirs").alias("near")), f"{name}-near")
        hooked = stored(labels.df.join(near.df, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{name}-hooked")
        up = hooked.df.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        new = stored(hooked.df.join(up, "label").select("node", "old", F.least("label", "upper").alias("label")), f"{name}-labels")
        changed = new.df.where("label <> old").limit(1).count()
        for t in (labels, near, hooked):
            t.drop()
        labels = new
        if not changed:
            both.drop()
            labels.df = labels.df.select("node", "label")
            return labels
