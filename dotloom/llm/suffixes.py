"""Repeated passages by a sparse suffix array.

Suffixes are kept where a word k-gram has the least hash of ``W`` consecutive ones (minimisers): equal passages of at
least W + K - 1 words keep equal positions. A suffix carries the words ahead of its k-gram and behind it, ``REACH`` each
way, as 24-bit hashes: more is never needed, as a longer passage has further minimisers whose stretches overlap.
Suffixes are sorted over the cluster by (k-gram, words ahead, words behind, document), in ranges. In a group of one
k-gram of at most ``NEAR`` + 1 rows that lies within a range, all are compared with each other and extended left and
right. In other groups a suffix is compared with its two neighbours, and the stretches of ``LEAST`` words around the
k-gram that those can't settle are keyed by content and by the k-gram's place in them: equal keys are repeats, whatever
lies between. A stretch is left out where it equals the row's before (a run is keyed once, by its first row), or where
it reaches further ahead than both neighbours agree (then no other row agrees either). The keys are sorted in ranges
too, so that even a passage of very many copies is dealt over tasks, and each is compared with its two neighbours;
range borders of the keys are compared in a pass over two rows a range. Matches are joined into passages, which don't
depend on how the rows were dealt. A border runs a word too far where two words share 24 bits: one in 16 million.

Defined results: null and empty texts have no passages; repeats inside one text and between rows that share a doc_id
count too; a null doc_id takes part and is reported as null; rows of equal doc_id and text are reported once, rows of
one doc_id (or of none) and different texts each; a text without passages gives no row; empty tables give empty ones;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import _splitmix, chunks, free_shuffles, mix, row_of, stored, window_hashes, with_only, word_hashes, words_of

#: Words of a k-gram, k-grams a minimiser is chosen from, least words of a repeat, words carried each way of the k-gram.
K, W, LEAST = 10, 40, 50
REACH = LEAST - K
#: Most other suffixes of a k-gram that all are compared with each other; in a larger group stretches are keyed.
NEAR = 16
SUFFIX = "gram long, ahead binary, behind binary, doc_id long, text_key long, at int"


def minimisers(words: np.ndarray, word_off: np.ndarray) -> np.ndarray:
    """Word positions of k-grams whose hash is the least of some W consecutive k-grams of their row (last of equals)."""
    out = []
    grams = window_hashes(words, K)
    for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
        n = b - a - K + 1
        if n < 1 or b - a < LEAST:
            continue
        h = mix(grams[a : a + n])
        w = min(W, n)
        view = np.lib.stride_tricks.sliding_window_view(h[::-1], w)
        for s in range(0, len(view), 200_000):
            at = np.arange(s, min(s + 200_000, len(view))) + np.argmin(view[s : s + 200_000], axis=1)
            out.append(a + n - 1 - np.unique(at))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _packed(words: np.ndarray) -> pa.Array:
    """Rows of 24-bit hashes as binary: their low 16 bits, then their high 8, so that rows sort by the former first."""
    data = np.concatenate([words.astype(np.uint16).view(np.uint8), (words >> np.uint32(16)).astype(np.uint8)], axis=1)
    size = np.arange(len(words) + 1, dtype=np.int32) * (3 * REACH)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(data))])


def suffixes(docs: DataFrame) -> DataFrame:
    """Rows of SUFFIX of (doc_id, text, text_key)."""

    def run(batches):
        for part, data, off in chunks(batches):
            s, e, word_off = words_of(data, off)
            words = word_hashes(data, s, e)
            at = minimisers(words, word_off)
            if not len(at):
                continue
            row = row_of(word_off)[at]
            grams = window_hashes(words, K)
            short = np.maximum((words >> np.uint64(40)).astype(np.uint32), 1)
            step = np.arange(REACH)
            for i in range(0, len(at), 10_000):
                p, r = at[i : i + 10_000], row[i : i + 10_000]
                right, left = p[:, None] + K + step, p[:, None] - 1 - step
                # 0 behind the ends: no word has it.
                behind = np.where(right < word_off[r + 1][:, None], short[np.minimum(right, len(short) - 1)], 0).astype(np.uint32)
                ahead = np.where(left >= word_off[r][:, None], short[np.maximum(left, 0)], 0).astype(np.uint32)
                who = [part.column(c).take(pa.array(r)).cast(pa.int64()) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([pa.array(grams[p].view(np.int64)), _packed(ahead), _packed(behind), *who, pa.array((p - word_off[r]).astype(np.int32))], ["gram", "ahead", "behind", "doc_id", "text_key", "at"])

    return docs.mapInArrow(run, SUFFIX)


def _rows(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    width = 3 * REACH
    return np.frombuffer(col.buffers()[2], np.uint8)[col.offset * width : (col.offset + len(col)) * width].reshape(-1, width)


def _low(col) -> np.ndarray:
    """The low 16 bits, which rows are sorted by."""
    return np.ascontiguousarray(_rows(col)[:, : 2 * REACH]).view(np.uint16)


def _matrix(col) -> np.ndarray:
    return _low(col) | (_rows(col)[:, 2 * REACH :].astype(np.uint32) << np.uint32(16))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal values from the start of each row; 0 ends a row."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


WHO = ["doc_id", "text_key"]
#: kind 0: matches, 1: keyed stretches; and with borders, 0: matches, 1: first and last rows of ranges.
OUT = "doc_id long, text_key long, s int, e int, key long, kind int"
EDGE = "doc_id long, text_key long, s int, e int, key long, kind int, border int"


def _give(t: pa.Table, pick: np.ndarray, s: np.ndarray, e: np.ndarray | None, key=None, **more: int):
    """Rows of OUT, with further int columns; ``e`` may be none."""
    n = len(pick)
    cols = [*[t.column(c).take(pa.array(pick)) for c in WHO], pa.array(s.astype(np.int32)), pa.nulls(n, pa.int32()) if e is None else pa.array(e.astype(np.int32)), pa.nulls(n, pa.int64()) if key is None else pa.array(key)]
    names = [*WHO, "s", "e", "key", *more]
    yield from pa.table([*cols, *[pa.array(np.full(n, v, np.int32)) for v in more.values()]], names=names).combine_chunks().to_batches()


def _compared(t: pa.Table, near: int = NEAR):
    """Matches of rows of one k-gram, up to ``near`` rows apart in a sorted table, reported for both."""
    gram, at = t.column("gram").to_numpy(), t.column("at").to_numpy()
    if len(gram) < 2:
        return
    ahead, behind = _matrix(t.column("ahead")), _matrix(t.column("behind"))
    parts = []
    for d in range(1, min(near, len(gram) - 1) + 1):
        same = np.flatnonzero(gram[d:] == gram[:-d])
        if not len(same):
            break
        left, right = _common(ahead[same], ahead[same + d]), K + _common(behind[same], behind[same + d])
        long = left + right >= LEAST
        parts.append((same[long], same[long] + d, left[long], right[long]))
    if not sum(len(p[0]) for p in parts):
        return
    i, j, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
    # One row for each place and reach is enough.
    pick, left, right = np.unique(np.stack([np.concatenate([i, j]), np.concatenate([left, left]), np.concatenate([right, right])]), axis=1)
    yield from _give(t, pick, at[pick] - left, at[pick] + right, kind=0)


def _stretches(t: pa.Table, done: int, wait: int, first: bool, last: bool):
    """Keys of stretches of ``LEAST`` words around each suffix's k-gram, by content and place of the k-gram.

    The first ``done`` and the last ``wait`` rows are neighbours only; ``first`` and ``last`` tell that more of the
    group may lie before the first row or behind the last one.
    """
    if t.num_rows <= done + wait:
        return
    gram, splits = t.column("gram").to_numpy(), np.arange(REACH + 1)
    ahead, behind, low = _matrix(t.column("ahead")), _matrix(t.column("behind")), _low(t.column("ahead"))
    same = gram[1:] == gram[:-1]
    left, right = np.where(same, _common(ahead[1:], ahead[:-1]), -1), np.where(same, K + _common(behind[1:], behind[:-1]), -1)
    # What the sort order tells is of the low bits alone: at least as far as the words agree.
    differ = low[1:] != low[:-1]
    order = np.where(same, np.where(differ.any(axis=1), differ.argmax(axis=1), REACH), -1)
    reach = np.maximum(np.append(-1, order), np.append(order, -1))
    if first:
        reach[0] = REACH
    if last:
        reach[-1] = REACH
    before, after, at = np.append(-1, left), np.append(-1, right), t.column("at").to_numpy()
    for i in range(done, t.num_rows - wait, 10_000):
        k = np.arange(i, min(i + 10_000, t.num_rows - wait))
        line = np.hstack([ahead[k][:, ::-1], behind[k]])
        start = REACH - splits
        want = (line[:, start] != 0) & (line[:, start + REACH - 1] != 0) & (splits <= reach[k, None])
        want &= (splits > before[k, None]) | (LEAST - splits > after[k, None])
        row, split = np.nonzero(want)
        if not len(row):
            continue
        start = row * (2 * REACH) + start[split]
        key = mix(window_hashes(mix(line.ravel().astype(np.uint64)), REACH)[start] ^ _splitmix(len(splits), 55)[split]) ^ gram[k[row]].view(np.uint64)
        s = at[k[row]] - split
        yield from _give(t, k[row], s, None, mix(key).view(np.int64), kind=1)  # e is s + LEAST


def _alike(t: pa.Table, **more: int):
    """Rows of a table sorted by key that have a neighbour of their key."""
    key = t.column("key").to_numpy()
    i = np.flatnonzero(key[1:] == key[:-1])
    pick = np.unique(np.concatenate([i, i + 1]))
    if len(pick):
        s = t.column("s").to_numpy()[pick]
        yield from _give(t, pick, s, s + LEAST, **more)


def _merged(batches):
    for batch in batches:
        out = []
        for who, m in zip(batch.column("doc_id").to_pylist(), batch.column("m").to_pylist(), strict=True):
            now = None
            for x in m:
                if now and x["s"] <= now[2]:
                    now[2] = max(now[2], x["e"])
                else:
                    now = [who, x["s"], x["e"]]
                    out.append(now)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["doc_id", "start_word", "end_word"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word) of each passage that repeats."""
    keyed = with_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    # Values behind the k-gram deal equal suffixes of many documents over ranges too.
    order = ["gram", "ahead", "behind", "doc_id", "at"]
    spread = suffixes(keyed).repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(batches):
        # The last group may go on in the next batch, the first and the last of a range in another range. Of an open
        # large group the last row is held, after ``done`` rows before it.
        held, now, large, done, first = None, None, True, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            gram = t.column("gram").to_numpy()
            head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            size = np.diff(np.append(head, len(gram)))
            keyed = size > NEAR + 1
            keyed[0] |= large and (now is None or now == gram[0])
            if not keyed[0]:
                done = 0
            mark, some = np.repeat(keyed, size), np.repeat(~keyed, size)
            now, large, some[head[-1] :] = gram[-1], bool(keyed[-1]), False
            many = t.filter(pa.array(mark)).combine_chunks()
            yield from _compared(many, 1)
            yield from _stretches(many, done, int(large), first, False)
            first = first and many.num_rows <= done + int(large)
            yield from _compared(t.filter(pa.array(some)).combine_chunks(), NEAR)
            done = int(large and size[-1] > 1)
            held = t.slice(t.num_rows - 1 - done if large else head[-1])
        if held is not None:
            held = held.combine_chunks()
            yield from _compared(held, 1)
            yield from _stretches(held, done, 0, first, True)

    both = stored(spread.mapInArrow(compare, OUT), "suffixes", "kind")
    del spread
    free_shuffles(docs.sparkSession)
    dealt = both.df.where("kind = 1").select(*WHO, "s", "key").repartitionByRange("key", *WHO, "s").sortWithinPartitions("key")

    def pair(batches):
        number, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = (t if last is None else pa.concat_tables([last, t])).combine_chunks()
            if last is None:
                yield from _border(t.slice(0, 1), 2 * number)
            yield from _alike(t, kind=0, border=0)
            last = t.slice(t.num_rows - 1)
        if last is not None:
            yield from _border(last, 2 * number + 1)

    def _border(t, number):
        yield from _give(t, np.zeros(1, np.int64), t.column("s").to_numpy(), None, t.column("key").to_numpy(), kind=1, border=number)

    near = stored(dealt.mapInArrow(pair, EDGE), "stretches", "kind")

    def meet(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            t = pa.Table.from_batches(rows).combine_chunks()
            for k in np.flatnonzero(t.column("border").to_numpy()[:-1] % 2 == 1).tolist():
                yield from _alike(t.slice(k, 2).combine_chunks(), kind=0)

    # Two rows a range, in files of their own: as many as there are ranges, not as there are documents.
    edges = near.df.where("kind = 1").coalesce(1).sortWithinPartitions("border").mapInArrow(meet, OUT)
    every = both.df.where("kind = 0").select(*WHO, "s", "e").union(near.df.where("kind = 0").select(*WHO, "s", "e")).union(edges.select(*WHO, "s", "e"))
    # A set: rows that repeat add nothing, so a group is as large as its text.
    per = every.groupBy(*WHO).agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("m"))
    return per.select("doc_id", "m").mapInArrow(_merged, "doc_id long, start_word long, end_word long")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that repeat in ``documents``."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
