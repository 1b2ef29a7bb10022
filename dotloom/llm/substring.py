"""Substring deduplication with a count-min prefilter.

A window is ``n`` consecutive words of one document. Each partition sketches its windows: two rows of cells that
count up to two. The sketches are merged by block of cells; a cell overestimates the count of each of its windows,
so a window that is repeated has a full cell in both rows and none is lost. The second pass groups, exactly (96-bit
hashes), only the windows whose cells are full. A window whose least document is smaller is removed.

The second pass reads the documents once. A task first groups the windows it holds: those that a smaller document of
the same task has are settled there, and leave as runs of places; only the least document of each window goes on to
the exchange by window, so that a window of very many documents costs a row a task. There rows are sorted by window and
document, and all behind the first document are settled.

The merged sketch keeps one bit a cell: ``2 ** bits`` cells a row, with ``bits`` grown from the input's bytes up to
``most_bits`` (2 x 64 MB), so what the driver gathers and broadcasts is bounded. Beyond that bound more windows pass
the prefilter and are grouped exactly; the result stays the same.

Defined results: a null or empty text has no words; a null doc_id neither removes nor loses words; rows that share a
doc_id don't remove from each other, and each row loses its own words alone; every row gives one row; empty tables
give empty ones; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import chunks, free_shuffles, inside, mix, row_of, with_only, word_hashes, window_hashes, words_of

#: Words of a window.
WINDOW = 13
#: Cells of a sketch row are 2**bits, at most 2**MOST_BITS; blocks have 2**16 cells.
MOST_BITS, BLOCK_BITS = 29, 16
#: Windows that a partition gathers before it gives out a sketch, and candidates that a task groups at once.
FLUSH, GROUP = 3_000_000, 400_000
#: A run of places: first place and number of places in one long.
RUN = 1 << 31


def windows(data: np.ndarray, off: np.ndarray, n: int):
    """Two hashes, row and first word's index of each window."""
    starts, ends, word_off = words_of(data, off)
    ok = np.flatnonzero(inside(word_off, n, len(starts)))
    hashes = [window_hashes(word_hashes(data, starts, ends, k), n, k)[ok] for k in (0, 1)]
    row = row_of(word_off)[ok]
    return hashes[0], hashes[1], row, ok - word_off[row]


def _gaps(sorted_low: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending 16-bit numbers as the bytes of their gaps (255: more to come), from anew where ``new``; and each one's first byte."""
    gap = sorted_low.astype(np.int32)
    gap[1:] -= np.where(new[1:], 0, gap[:-1]) if len(gap) > 1 else 0
    more = gap // 255
    end = np.cumsum(more + 1)
    out = np.full(int(end[-1]) if len(end) else 0, 255, np.uint8)
    out[end - 1] = gap % 255
    return out, np.concatenate([[0], end])


def _ungap(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    return np.cumsum(x, dtype=np.int64)[x != 255]


def _sketch_rows(cells: list, bits: int):
    """Cells of both rows as (block, cells seen once, cells seen more often), as gaps."""
    edges = np.arange((1 << (bits - BLOCK_BITS)) + 1, dtype=np.int32) << BLOCK_BITS
    for k in (0, 1):
        c, cells[k] = cells[k], None
        u, count = np.unique(c, return_counts=True)
        cols = []
        for part in (u[count == 1], u[count > 1]):
            block = part >> BLOCK_BITS
            raw, at = _gaps(part & 0xFFFF, np.concatenate([[True], block[1:] != block[:-1]]) if len(part) else np.zeros(0, bool))
            cut = at[np.searchsorted(part, edges)].astype(np.int32)
            cols.append(pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(cut), pa.py_buffer(raw)]))
        blocks = pa.array(np.arange(len(edges) - 1, dtype=np.int32) + k * (len(edges) - 1))
        batch = pa.RecordBatch.from_arrays([blocks, *cols], ["block", "once", "often"])
        for at in range(0, batch.num_rows, 1024):
            yield batch.slice(at, 1024)


def sketch(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Merged sketch: (block, full), ``full`` a bit for each cell that counts two or more."""

    def partial(batches):
        kept, total = [], 0
        for _, data, off in chunks(batches):
            h0, h1, row, _ = windows(data, off, n)
            # A window that repeats in one document alone removes nothing: it counts once a document.
            once = np.unique(mix(h0 ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
            h0, h1 = h0[once], h1[once]
            kept.append([(h >> np.uint64(64 - bits)).astype(np.int32) for h in (h0, h1)])
            total += len(h0)
            if total >= FLUSH:
                yield from _sketch_rows([np.concatenate([x[k] for x in kept]) for k in (0, 1)], bits)
                kept, total = [], 0
        if total:
            yield from _sketch_rows([np.concatenate([x[k] for x in kept]) for k in (0, 1)], bits)

    def merge(batches):
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, once, often in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not once and not often:
                    continue
                have = seen.setdefault(block, [np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)])
                for cells in (_ungap(once), _ungap(often)):
                    have[1][cells[have[0][cells]]] = True
                    have[0][cells] = True
                have[1][_ungap(often)] = True
        for block, (_, full) in seen.items():
            if full.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(full).tobytes()], pa.binary())], ["block", "full"])

    parts = docs.mapInArrow(partial, "block int, once binary, often binary").where("length(once) + length(often) > 0")
    return parts.repartition(max(8, 1 << max(0, bits - 23)), "block").mapInArrow(merge, "block int, full binary")


def _settled(h0: np.ndarray, h1: np.ndarray, doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Windows of one task: rows to exchange (run 0), and runs of places that a smaller document of the task settles."""
    order = np.lexsort((at, key, doc, h0))
    h0, h1, doc, key, at = (x[order] for x in (h0, h1, doc, key, at))
    new = np.concatenate([[True], (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    # A window of a row that repeats, whole rows that repeat too, goes on once.
    again = np.concatenate([[False], ~new[1:] & (doc[1:] == doc[:-1]) & (key[1:] == key[:-1])])
    go = np.flatnonzero((doc == least) & ~again)
    own = np.flatnonzero(doc > least)
    own = own[np.lexsort((at[own], key[own], doc[own]))]
    d, k, p = doc[own], key[own], at[own]
    dup = np.concatenate([[False], (d[1:] == d[:-1]) & (k[1:] == k[:-1]) & (p[1:] == p[:-1])]) if len(own) else np.zeros(0, bool)
    d, k, p = d[~dup], k[~dup], p[~dup]
    head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(d)))
    d, k, p = d[head], k[head], p[head]
    # Settled runs are dealt out by what they are.
    spread = mix(mix(d.view(np.uint64)) ^ p.astype(np.uint64)).view(np.int64)
    # In the order of the rows, so that what a row's windows share lies together in the exchange.
    go = go[np.argsort(order[go])]
    cols = [(h0[go].view(np.int64), spread), (h1[go], np.zeros(len(d), np.int64)), (doc[go], d), (key[go], k), (at[go] * RUN, p * RUN + size)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], ["h0", "h1", "doc_id", "key", "run"])


def repeated_candidates(docs: DataFrame, n: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """(h0, h1, doc_id, key, run) of the windows that the sketch estimates as repeated, see ``_settled``; ``key`` tells rows of one doc_id apart."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(BLOCK_BITS, math.ceil(math.log2(size / 2 + 2))))
    blocks = 1 << (bits - BLOCK_BITS)
    full = np.zeros((2 * blocks, (1 << BLOCK_BITS) // 8), np.uint8)
    found = sketch(docs, n, bits).toArrow()
    for block, cells in zip(found.column("block").to_pylist(), found.column("full"), strict=True):
        full[block] = np.frombuffer(cells.as_buffer(), np.uint8)
    # Few cells are full; workers get the bits compressed.
    shared = docs.sparkSession.sparkContext.broadcast([zlib.compress(x.tobytes(), 1) for x in full.reshape(2, -1)])
    del full, found
    free_shuffles(docs.sparkSession)

    def run(batches):
        rows, held, total = [np.frombuffer(zlib.decompress(x), np.uint8) for x in shared.value], [], 0
        for part, data, off in chunks(batches):
            h = windows(data, off, n)
            ok = np.ones(len(h[0]), bool)
            for k in (0, 1):
                cell = h[k] >> np.uint64(64 - bits)
                ok &= (rows[k][(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 > 0
            if not ok.any():
                continue
            who, key = (part.column(c).cast(pa.int64()).to_numpy() for c in ("doc_id", "key"))
            held.append((h[0][ok], h[1][ok] >> np.uint64(32), who[h[2][ok]], key[h[2][ok]], h[3][ok]))
            total += len(held[-1][0])
            while total >= GROUP:
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield _settled(*[x[:GROUP] for x in every])
                held, total = [tuple(x[GROUP:] for x in every)], total - GROUP
        if total:
            yield _settled(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return docs.mapInArrow(run, "h0 long, h1 long, doc_id long, key long, run long")


def removed_starts(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, key, runs): runs of first words of a row's windows that also start in a smaller document; of equal windows of a row one at least."""
    order = ["h0", "h1", "doc_id"]
    dealt = repeated_candidates(docs, n).repartition("h0", "h1").sortWithinPartitions(*order)

    def settle(batches):
        last = None  # window and least document of the group that may go on
        for batch in batches:
            run = batch.column("run").to_numpy()
            known = run % RUN > 0
            h0, h1, doc = (batch.column(c).to_numpy()[~known] for c in order)
            hit = known.copy()
            if len(h0):
                new = np.concatenate([[last is None or last[:2] != (h0[0], h1[0])], (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])])
                heads = doc[new] if new[0] else np.concatenate([[last[2]], doc[new]])
                least = heads[np.cumsum(new) - int(new[0])]
                hit[~known] = doc > least
                last = (h0[-1], h1[-1], least[-1])
            if hit.any():
                pick = pa.array(hit)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pick), batch.column("key").filter(pick), pa.array(np.where(known, run, run + 1)[hit])], ["doc_id", "key", "run"])

    hits = dealt.mapInArrow(settle, "doc_id long, key long, run long")
    return hits.groupBy("doc_id", "key").agg(F.collect_set("run").alias("runs"))


def remove_repeats(docs: DataFrame, n: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, text), ``text`` the kept words joined by one space; with ``digest`` its SHA-256 instead."""
    d = with_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    some = d.where("doc_id IS NOT NULL")
    marked = some.join(removed_starts(some, n), ["doc_id", "key"], "left").select("doc_id", "text", "runs")
    marked = marked.union(d.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<long>")))

    def run(batches):
        for part, data, off in chunks(batches):
            starts, ends, word_off = words_of(data, off)
            hits = part.column("runs")
            h = window_hashes(word_hashes(data, starts, ends, 1), n, 1) if hits.null_count < len(hits) else None
            raw, out = data.tobytes(), []
            for r in range(part.num_rows):
                a, b = int(word_off[r]), int(word_off[r + 1])
                gone = np.zeros(b - a + n + 1, np.int64)
                if hits[r].is_valid:
                    code = hits[r].values.to_numpy(zero_copy_only=False)
                    first, size = code // RUN, code % RUN
                    at = np.unique(np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum()))
                    # The same window elsewhere in the row goes as well.
                    own = h[a : b - n + 1]
                    at = np.flatnonzero(np.isin(own, own[at]))
                    gone[at] += 1
                    gone[at + n] -= 1
                keep = np.cumsum(gone)[: b - a] == 0
                s, e = starts[a:b][keep].tolist(), ends[a:b][keep].tolist()
                out.append((b - a, b - a - len(s), b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)])))
            last = [hashlib.sha256(x[2]).hexdigest() if digest else x[2].decode("utf-8", "replace") for x in out]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(last, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text"],
            )

    return marked.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` left after removal of 13-word windows that also start in a smaller document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP8_SQL = r"""WITH d AS (SELECT row_number() OVER () AS o, doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT o, doc_id, i, md5(array_to_string(ws[i:i+12], ' ')) AS h FROM (SELECT o, doc_id, ws, unnest(generate_series(1, len(ws)-12)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS least FROM w GROUP BY 1),
r AS (SELECT DISTINCT o, unnest(generate_series(i, i+12)) AS k FROM w JOIN f USING (h) WHERE doc_id > least),
x AS (SELECT o, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS k FROM d),
s AS (SELECT x.o, count(r.k) AS n_removed, string_agg(word, ' ' ORDER BY x.k) FILTER (WHERE r.k IS NULL) AS kept FROM x LEFT JOIN r ON r.o=x.o AND r.k=x.k GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (o)"""
