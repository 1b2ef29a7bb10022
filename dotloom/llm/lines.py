"""Incremental line deduplication: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without blanks at its ends, A-Z in lower case; keys travel as 128-bit hashes. A ``LineIndex``
holds, for each key, the exact number of documents that have it (``counts``), and for each shard of keys a cuckoo filter
of those that at least ``least`` documents have (``filters``). ``insert`` and ``delete`` add and take the documents'
counts, and then put into the filters, or take out, only the keys that crossed the bar, so deleting documents restores
the state before their insertion. A shard that becomes too full is built anew, larger, from the exact counts; with very
many keys so are all, in more shards. A fingerprint that finds no slot goes to its shard's stash, so no key is lost.

``drop_lines`` asks the filters first, so that only lines that may be frequent leave a task, and then the exact counts,
which settles the filters' false positives. Filters are broadcast in groups of at most ``FILTER_BYTES``, one pass over
the texts for each. A line of very many documents is counted once a batch before the exchange; where its hits meet the
counts, adaptive execution splits them.

Defined results: a row is a document, also where rows repeat or lack an id; a key counts once a row. A null or empty
text is one empty line. Lines with an empty key stay. Deleting what was never inserted raises ValueError and leaves the
index as it was. Empty tables give empty ones; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import _SPACE, chunks, free_shuffles, mix, row_of, stored, with_only, word_hashes, words_of

#: Least number of documents of a line that goes.
LEAST = 10
#: Keys of a shard, least number of shards, highest load of a filter, bytes of filters broadcast at once.
SHARD_KEYS, SHARDS, LOAD, FILTER_BYTES = 1 << 18, 16, 0.85, 64_000_000
KICKS = 500

_BREAK = np.zeros(256, bool)
_BREAK[10] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- keys
def keyed_lines(data: np.ndarray, off: np.ndarray):
    """Starts and ends of the lines that have a key, their row, and the two halves of its hash."""
    starts, ends, line_off = words_of(data, off, _BREAK)
    solid = np.flatnonzero(~_SPACE[data])
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    has = first < last
    starts, ends, row = starts[has], ends[has], row_of(line_off)[has]
    s, e = solid[first[has]], solid[last[has] - 1] + 1
    low = _LOWER[data]
    return starts, ends, row, word_hashes(low, s, e, 0).view(np.int64), word_hashes(low, s, e, 1).view(np.int64)


def line_counts(docs: DataFrame) -> DataFrame:
    """(h0, h1, docs): the number of rows that have each key."""

    def run(batches):
        for _, data, off in chunks(batches):
            _, _, row, h0, h1 = keyed_lines(data, off)
            if not len(row):
                continue
            order = np.lexsort((row, h1, h0))
            h0, h1, row = h0[order], h1[order], row[order]
            new = np.concatenate([[True], (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])])
            once = new | np.concatenate([[True], row[1:] != row[:-1]])
            head = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(h0[head]), pa.array(h1[head]), pa.array(np.add.reduceat(once.astype(np.int64), head))], ["h0", "h1", "docs"])

    return with_only(docs, "text").mapInArrow(run, "h0 long, h1 long, docs long").groupBy("h0", "h1").agg(F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- cuckoo filter
class Cuckoo:
    """A cuckoo filter with buckets of four 16-bit fingerprints; ``stash`` has the keys that found no slot."""

    def __init__(self, buckets: int, slots: bytes | None = None, stash=()):
        self.mask = buckets - 1
        self.slots = np.zeros((buckets, 4), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(buckets, 4).copy()
        self.stash = list(stash)

    @staticmethod
    def size_for(keys: int) -> int:
        """Buckets, a power of two, for so many keys at half the highest load."""
        return 1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (2 * LOAD)))))

    def _placed(self, h0: np.ndarray, h1: np.ndarray):
        mark = (h1.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (h0.view(np.uint64) & np.uint64(self.mask)).astype(np.int64)
        return mark, one, one ^ self._jump(mark)

    def _jump(self, mark):
        return (mix(np.asarray(mark, np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def insert(self, h0: np.ndarray, h1: np.ndarray) -> None:
        """Adds different keys that are not in the filter."""
        mark, one, two = self._placed(h0, h1)
        left = np.arange(len(mark))
        for where in (one, two):
            left = left[np.argsort(where[left], kind="stable")]
            bucket = where[left]
            new = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, bool)
            place = np.arange(len(left)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(left) else left
            used = self.slots[bucket] != 0
            fits = place < 4 - used.sum(axis=1)
            slot = np.argsort(used, axis=1, kind="stable")[np.flatnonzero(fits), place[fits]]
            self.slots[bucket[fits], slot] = mark[left[fits]]
            left = left[~fits]
        for i in left.tolist():
            self._kick(int(h0[i]), mark[i], int(two[i]))

    def _kick(self, key: int, mark, at: int) -> None:
        path = []
        for k in range(KICKS):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return
            slot = k & 3
            path.append((at, slot, self.slots[at, slot]))
            self.slots[at, slot], mark = mark, self.slots[at, slot]
            at ^= int(self._jump(mark))
        for bucket, slot, old in reversed(path):  # no way in: all back, the key to the stash
            self.slots[bucket, slot] = old
        self.stash.append(key)

    def delete(self, h0: np.ndarray, h1: np.ndarray) -> None:
        """Takes out keys that are in the filter."""
        for key, mark, *where in zip(h0.tolist(), *self._placed(h0, h1), strict=True):
            if key in self.stash:
                self.stash.remove(key)
                continue
            for at in where:
                hit = np.flatnonzero(self.slots[at] == mark)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break

    def contains(self, h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
        """Marks the keys that may be in the filter; all that are."""
        mark, one, two = self._placed(h0, h1)
        hit = (self.slots[one] == mark[:, None]).any(axis=1) | (self.slots[two] == mark[:, None]).any(axis=1)
        return hit | np.isin(h0, np.array(self.stash, np.int64)) if self.stash else hit


# ---------------------------------------------------------------- index
FILTER = "shard int, buckets int, keys long, slots binary, stash array<long>"


def _shard(bits: int):
    return F.shiftrightunsigned("h0", 64 - bits).cast("int")


class LineIndex:
    """Exact document counts of line keys, and the filters over them, as tables in the shared folder."""

    def __init__(self, spark: SparkSession, least: int = LEAST):
        self.spark, self.least, self.bits = spark, least, SHARDS.bit_length() - 1
        self._counts = self._filters = None

    @property
    def counts(self) -> DataFrame:
        """(h0, h1, docs, turn): ``turn`` 1 or -1 where the last change crossed the bar."""
        return self._counts.df if self._counts else self.spark.createDataFrame([], "h0 long, h1 long, docs long, turn int")

    @property
    def filters(self) -> DataFrame:
        """A row of FILTER for each shard that has keys."""
        return self._filters.df if self._filters else self.spark.createDataFrame([], FILTER)

    def frequent(self) -> DataFrame:
        """(h0, h1) of the keys at the bar."""
        return self.counts.where(F.col("docs") >= self.least).select("h0", "h1")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> LineIndex:
        change = line_counts(docs).select("h0", "h1", (F.col("docs") * sign).alias("change"), F.lit(0).cast("long").alias("before"))
        if self._counts:
            both = change.union(self.counts.select("h0", "h1", F.lit(0).cast("long"), "docs"))
            change = both.groupBy("h0", "h1").agg(F.sum("change").alias("change"), F.sum("before").alias("before"))
        now = F.col("before") + F.col("change")
        turn = (now >= self.least).cast("int") - (F.col("before") >= self.least).cast("int")
        new = stored(change.select("h0", "h1", now.alias("docs"), turn.alias("turn")).where("docs <> 0 OR turn <> 0"), "line-counts")
        if sign < 0 and new.df.where("docs < 0").limit(1).count():
            new.drop()
            raise ValueError("a document to delete has lines that the index does not hold")
        old, self._counts = self._counts, new
        self._refilter()
        if old:
            old.drop()
        return self

    def _refilter(self) -> None:
        """Brings the filters to the new counts; filters that would be too full are built anew."""
        least, total = self.least, self.frequent().count()
        bits = max(self.bits, int(np.ceil(np.log2(max(total, 1) / SHARD_KEYS))))
        grown, self.bits = bits > self.bits, bits
        has = self.counts.withColumn("shard", _shard(bits))
        had = {} if grown else {r.shard: r.buckets for r in self.filters.select("shard", "buckets").collect()}
        want = {r.shard: r.n for r in has.where(F.col("docs") >= least).groupBy("shard").agg(F.count("*").alias("n")).collect()}
        anew = [s for s, n in want.items() if n > LOAD * 4 * had.get(s, 0)]
        at_bar, turned = F.col("docs") >= least, F.col("turn") != 0
        rows = has.where(F.when(F.col("shard").isin(anew), at_bar).otherwise(turned)).select("shard", "h0", "h1", F.when(at_bar, 1).otherwise(-1).alias("turn"))
        kept = self.filters.where(~F.col("shard").isin(anew)) if not grown else self.spark.createDataFrame([], FILTER)

        def merge(rows: pa.Table, filters: pa.Table) -> pa.Table:
            if filters.num_rows:
                f = filters.to_pylist()[0]
                shard, keys, c = f["shard"], f["keys"], Cuckoo(f["buckets"], f["slots"], f["stash"])
            else:
                shard, keys, c = rows.column("shard")[0].as_py(), 0, Cuckoo(Cuckoo.size_for(rows.num_rows))
            if rows.num_rows:
                h0, h1, turn = (rows.column(x).to_numpy() for x in ("h0", "h1", "turn"))
                c.delete(h0[turn < 0], h1[turn < 0])
                c.insert(h0[turn > 0], h1[turn > 0])
                keys += int(turn.sum())
            row = {"shard": shard, "buckets": c.mask + 1, "keys": keys, "slots": c.slots.tobytes(), "stash": c.stash}
            return pa.Table.from_pylist([row] if keys else [], pa.schema([("shard", pa.int32()), ("buckets", pa.int32()), ("keys", pa.int64()), ("slots", pa.binary()), ("stash", pa.list_(pa.int64()))]))

        new = stored(rows.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(merge, FILTER), "line-filters")
        if self._filters:
            self._filters.drop()
        self._filters = new

    def drop(self) -> None:
        """Deletes the tables."""
        for t in (self._counts, self._filters):
            if t:
                t.drop()
        self._counts = self._filters = None


# ---------------------------------------------------------------- lines of documents
def _groups(index: LineIndex, limit: int):
    """Shards whose filters are broadcast together."""
    group, size = [], 0
    for shard, n in sorted(map(tuple, index.filters.select("shard", F.length("slots") + 8 * F.size("stash")).collect())):
        if group and size + n > limit:
            yield group
            group, size = [], 0
        group.append(shard)
        size += n
    if group:
        yield group


def candidates(docs: DataFrame, index: LineIndex, limit: int = FILTER_BYTES) -> DataFrame:
    """(tid, h0, h1) of the keys of each text (``tid``, ``text``) that the filters know."""
    bits, out = index.bits, docs.sparkSession.createDataFrame([], "tid long, h0 long, h1 long")
    for group in _groups(index, limit):
        rows = index.filters.where(F.col("shard").isin(group)).collect()
        shared = docs.sparkSession.sparkContext.broadcast([(r.shard, r.buckets, bytes(r.slots), list(r.stash)) for r in rows])

        def run(batches, shared=shared):
            filters = {s: Cuckoo(b, slots, stash) for s, b, slots, stash in shared.value}
            for part, data, off in chunks(batches):
                _, _, row, h0, h1 = keyed_lines(data, off)
                shard = (h0.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                hit = np.zeros(len(row), bool)
                order = np.argsort(shard, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                    if f := filters.get(int(shard[mine[0]])):
                        hit[mine] = f.contains(h0[mine], h1[mine])
                tid = part.column("tid").to_numpy()[row[hit]]
                if len(tid):
                    tid, h0, h1 = np.unique(np.stack([tid, h0[hit], h1[hit]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(h0), pa.array(h1)], ["tid", "h0", "h1"])

        out = out.union(docs.mapInArrow(run, "tid long, h0 long, h1 long"))
    return out


def drop_lines(docs: DataFrame, index: LineIndex, digest: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) without the lines whose key is at the index's bar; with ``digest`` the text's SHA-256 instead."""
    # Rows that share a tid have the same lines, or lines that are all judged by the same counts.
    d = with_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tid"))
    hits = candidates(d.select("tid", "text"), index).join(index.frequent(), ["h0", "h1"])
    # Written first: as both sides then come from an exchange alone, the rows of a text of very many copies can be split.
    # The same kind of join at every size.
    gone = stored(hits.groupBy("tid").agg(F.collect_set("h0").alias("gone")), "line-hits")
    marked = d.join(gone.df.hint("merge"), "tid", "left").select("doc_id", "text", "gone")

    def run(batches):
        for part, data, off in chunks(batches):
            gone, raw = part.column("gone"), data.tobytes()
            starts, ends, row, h0, _ = keyed_lines(data, off) if gone.null_count < len(gone) else [np.zeros(0, np.int64)] * 5
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            out = []
            for r in range(part.num_rows):
                text = raw[off[r] : off[r + 1]]
                lines, dropped = text.count(b"\n") + 1, 0
                if gone[r].is_valid:
                    a, b = at[r], at[r + 1]
                    s = starts[a:b][np.isin(h0[a:b], gone[r].values.to_numpy())] - off[r]
                    dropped = len(s)
                    begin = set(s.tolist())
                    kept, here = [], 0
                    for line in text.split(b"\n"):
                        if here not in begin:
                            kept.append(line)
                        here += len(line) + 1
                    text = b"\n".join(kept)
                out.append((lines, dropped, hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256" if digest else "text"],
            )

    return marked.mapInArrow(run, f"doc_id long, n_lines long, n_dropped long, {'kept_sha256' if digest else 'text'} string")


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the lines that at least ten of them have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = LineIndex(spark).insert(docs)
    free_shuffles(spark)
    return drop_lines(docs, index, digest=True)


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS o, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT o, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT o) >= 10),
r AS (SELECT o, count(*) AS n_lines, count(f.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '') AS kept FROM k LEFT JOIN f USING (key) GROUP BY o)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN r USING (o)"""
