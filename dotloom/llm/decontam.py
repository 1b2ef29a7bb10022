"""Benchmark decontamination by CGK embedding and bit sampling.

Texts become lower-case words of letters and digits. A match is a stretch of a document whose edit distance to an item,
in words, is at most a fifth of the item's words. A window the size of an item is embedded by a random walk
(Chakraborty, Goldenberg, Koucky): step t gives out the current word and moves on if a random bit of (t, word) is set,
so that few edits give few differing steps. Each of many walks is sampled at ``SAMPLED`` steps; a window and an item
that agree in a sample are a candidate, and an alignment of words verifies it exactly. The number of walks is computed
for each size of item from simulated copies with as many edits as are allowed, so that the target recall holds at the
edit bound for long items too (``walks_for``).

Windows are embedded where an item can be: e edits leave at least m - q + 1 - q * e of an item's q-grams whole, and
move them by at most e words against each other, so a place with fewer has no match (this loses none). The benchmark
goes to the workers in blocks of ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters, one pass over the documents and
one broadcast at a time.

Stretches of one item don't overlap: the best one of a place is given out, and then those left and right of it.

Defined results: null and empty texts match nothing, as do items under two words; items of equal text are matched
each; rows that repeat give a row each; null ids stay null; empty tables give empty ones; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotloom.llm.common import _splitmix, chunks, inside, mix, row_of, stored, text_buffers, window_hashes, with_only, word_hashes, words_of

#: Edits as a share of an item's words; items and characters of a block.
EDITS, BLOCK_ITEMS, BLOCK_CHARS = 0.2, 20_000, 8_000_000
#: Target recall at the edit bound, sampled steps of a walk, simulated copies for each size, most equal q-grams that are worked on at once.
RECALL, SAMPLED, COPIES, MOST_PAIRS = 0.99, 2, 256, 2_000_000
_END = np.uint64(0x5851F42D4C957F2D)
SCHEMA = "doc_id long, item_id long, distance int, item_words int, start_word long, end_word long"
_SEP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _edits(m):
    """Most edits of items of m words (a number or an array)."""
    return np.floor(EDITS * m + 1e-9).astype(np.int64)


def _q(m: int) -> int:
    return 3 if m >= 8 else 2


def _least(m: np.ndarray, q: int) -> np.ndarray:
    """q-grams of an item of m words that the most edits leave whole, one at least."""
    return np.maximum(m - q + 1 - q * _edits(m), 1)


def lowered(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col)


def embedded(words: np.ndarray, start: np.ndarray, size: np.ndarray, end: np.ndarray, first: int, last: int) -> np.ndarray:
    """Windows x walks x SAMPLED: what the walks ``first`` to ``last`` give out at their sampled steps.

    A window has ``size`` words from ``start`` on, none from ``end`` on; behind it stands ``_END``. Walks have 2 * size steps.
    """
    n, walks = len(start), last - first
    share = (_splitmix(SAMPLED * last, 71)[SAMPLED * first :] >> np.uint64(11)).astype(float) / 2.0**53
    step = (share.reshape(1, walks, SAMPLED) * (2 * size)[:, None, None]).astype(np.int64)
    seed = _splitmix(last, 1000)[first:]
    at, out = np.zeros((n, walks), np.int64), np.full((n, walks, SAMPLED), _END)
    top = np.minimum(size, end - start)[:, None]
    for t in range(int(step.max()) + 1 if step.size else 0):
        sym = np.where(at < top, words[np.minimum(start[:, None] + at, len(words) - 1)], _END)
        now = step == t
        if now.any():
            out[now] = np.broadcast_to(sym[:, :, None], now.shape)[now]
        at += (mix(sym ^ mix(seed + np.uint64(t))[None, :]) & np.uint64(1)).astype(np.int64)
    return out


@cache
def walks_for(m: int) -> int:
    """Walks for items of m words: the target recall over ``COPIES`` simulated copies at the edit bound, and half as many again."""
    e = int(_edits(m))
    if not e:
        return 1
    rng = np.random.default_rng([m, 5])
    item, fresh = _splitmix(m, 7), iter(_splitmix(COPIES * (m + e + 1), 9).tolist())
    texts = []
    for c in range(COPIES):
        t = item.tolist()
        for p in sorted(rng.choice(m, e, replace=False).tolist(), reverse=True):
            kind = 0 if c % 2 else rng.integers(3)
            t[p : p + 1] = [next(fresh)] if kind == 0 else [] if kind == 1 else [t[p], next(fresh)]
        texts.append([*t, *(next(fresh) for _ in range(m + e - len(t)))][: m + e])
    words, size, each = np.array(texts, np.uint64).ravel(), np.full(COPIES, m), np.arange(COPIES)
    left, walks = np.ones(COPIES, bool), 0
    while left.sum() > (1 - RECALL) * COPIES:
        one = embedded(item, np.zeros(1, np.int64), size[:1], size[:1], walks, walks + 8)
        got = embedded(words, each[left] * (m + e), size[left], (each[left] + 1) * (m + e), walks, walks + 8)
        left[np.flatnonzero(left)[(got == one).all(axis=2).any(axis=1)]] = False
        walks += 8
    return walks + walks // 2


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # q: sorted hashes, item, offset
    size: np.ndarray
    samples: list[np.ndarray]  # walks x SAMPLED


def load_items(ids: list, texts: list) -> Items:
    data, off = text_buffers(lowered(pa.array(texts, pa.string())))
    s, e, word_off = words_of(data, off, _SEP)
    h = word_hashes(data, s, e)
    words = [h[a:b] for a, b in zip(word_off, word_off[1:], strict=False)]
    grams = {}
    for q in (2, 3):
        some = [i for i, w in enumerate(words) if len(w) >= 2 and _q(len(w)) == q]
        if some:
            g = [window_hashes(words[i], q) for i in some]
            flat, item, at = np.concatenate(g), np.repeat(some, [len(x) for x in g]), np.concatenate([np.arange(len(x)) for x in g])
            order = np.argsort(flat, kind="stable")
            grams[q] = (flat[order], item[order], at[order])
    size = np.array([len(w) for w in words], np.int64)
    samples: list = [None] * len(words)
    for m in np.unique(size[size >= 2]).tolist():
        some = np.flatnonzero(size == m)
        for k in range(0, len(some), 500):
            part = some[k : k + 500]
            got = embedded(h, word_off[part], size[part], word_off[part + 1], 0, walks_for(m))
            for i, x in zip(part.tolist(), got, strict=True):
                samples[i] = x
    return Items(ids, words, grams, size, samples)


def _ranges(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each equal pair: index into ``values`` and into the sorted ``table``."""
    lo = np.searchsorted(table, values, side="left")
    n = np.searchsorted(table, values, side="right") - lo
    which = np.repeat(np.arange(len(values)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to a stretch of the text, and that stretch (first of equals)."""
    n = len(text)
    dist, begin, steps = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for k, w in enumerate(item.tolist()):
        diag = dist[:-1] + (text != np.uint64(w))
        up = dist[1:] + 1
        best = np.concatenate([[k + 1], np.minimum(diag, up)])
        frm = np.concatenate([[0], np.where(diag <= up, begin[:-1], begin[1:])])
        # A step along the text costs one: the least of best[j] - j over earlier j, plus the way.
        low = np.minimum.accumulate(best - steps)
        src = np.maximum.accumulate(np.where(best - steps == low, steps, 0))
        dist, begin = low + steps, frm[src]
    end = int(np.argmin(dist))
    return int(dist[end]), int(begin[end]), end


def stretches(item: np.ndarray, text: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """Distance, start and end of stretches that don't overlap: the best one, then those left and right of it, until none is within ``most``."""
    out, parts = [], [(0, len(text))]
    while parts:
        a, b = parts.pop()
        if b - a < max(len(item) - most, 1):
            continue
        d, x, y = align(item, text[a:b])
        if d <= most:
            out.append((d, a + x, a + y))
            parts += [(a, a + x), (a + y, b)]
    return out


def _places(words: np.ndarray, word_off: np.ndarray, items: Items) -> np.ndarray:
    """(row * items + item, start) of the starts that pass the banded q-gram count, in order."""
    row_all, n_items, found = row_of(word_off), len(items.ids), []
    for q, (table, t_item, t_at) in items.grams.items():
        ok = np.flatnonzero(inside(word_off, q, len(words)))
        which, entry = _ranges(table, window_hashes(words, q)[ok])
        if not len(which):
            continue
        pos, item, at = ok[which], t_item[entry], t_at[entry]
        pair = row_all[pos] * n_items + item
        # Distinct grams of an item that a row holds: at least the lemma's number.
        seen = np.unique(np.stack([pair, at]), axis=1)[0]
        pairs, n = np.unique(seen, return_counts=True)
        good = pairs[n >= _least(items.size[pairs % n_items], q)]
        keep = np.isin(pair, good)
        pair, start = pair[keep], pos[keep] - at[keep]
        order = np.lexsort((start, pair))
        pair, start = pair[order], start[order]
        # And so many of them within e words: the k-th and the one that many further on.
        size = items.size[pair % n_items]
        far = np.arange(len(pair)) + _least(size, q) - 1
        there = np.minimum(far, len(pair) - 1)
        near = np.flatnonzero((far < len(pair)) & (pair[there] == pair) & (start[there] - start <= _edits(size)))
        # All starts of such a band.
        band = np.zeros(len(pair) + 1, np.int64)
        np.add.at(band, near, 1)
        np.add.at(band, there[near] + 1, -1)
        band = np.cumsum(band)[:-1] > 0
        found.append(np.unique(np.stack([pair[band], start[band]]), axis=1))
    found = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return found[:, np.lexsort((found[1], found[0]))]


def _sampled(words: np.ndarray, word_off: np.ndarray, items: Items, place: np.ndarray) -> np.ndarray:
    """Marks the places whose window agrees with the item in a sample of some walk."""
    row, item = np.divmod(place[0], len(items.ids))
    size, need = items.size[item], np.array([len(items.samples[i]) for i in item.tolist()])
    start, end = np.maximum(place[1], word_off[row]), word_off[row + 1]
    hit, first = np.zeros(len(row), bool), 0
    todo = np.arange(len(row))
    while len(todo):
        last = first + 8
        for k in range(0, len(todo), 4000):
            part = todo[k : k + 4000]
            got = embedded(words, start[part], size[part], end[part], first, last)
            own = np.zeros_like(got)
            for j, i in enumerate(item[part].tolist()):
                x = items.samples[i][first:last]
                own[j, : len(x)] = x
            same = (got == own).all(axis=2) & (np.arange(first, last) < need[part, None])
            hit[part[same.any(axis=1)]] = True
        first = last
        todo = todo[~hit[todo] & (need[todo] > first)]
    return hit


def _groups(words: np.ndarray, word_off: np.ndarray, items: Items):
    """Ranges of rows whose q-grams meet at most MOST_PAIRS item q-grams (or one row)."""
    n = np.zeros(len(words) + 1, np.int64)
    for q, (table, _, _) in items.grams.items():
        h = window_hashes(words, q)
        n[1 : len(h) + 1] += np.searchsorted(table, h, side="right") - np.searchsorted(table, h, side="left")
    at, a = np.cumsum(n)[word_off], 0
    while a < len(word_off) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + MOST_PAIRS, side="right")) - 1)
        yield a, b
        a = b


def matches(words: np.ndarray, word_off: np.ndarray, items: Items):
    """(row, item, distance, start, end) for each stretch of a row's words that an item matches."""
    for a, b in _groups(words, word_off, items):
        for r, *rest in _matched(words[word_off[a] : word_off[b]], word_off[a : b + 1] - word_off[a], items):
            yield a + r, *rest


def _matched(words: np.ndarray, word_off: np.ndarray, items: Items):
    place = _places(words, word_off, items)
    if not place.shape[1]:
        return
    place = place[:, _sampled(words, word_off, items, place)]
    spans: list[list[int]] = []
    for p, s in place.T.tolist():
        if spans and spans[-1][0] == p and s - spans[-1][2] <= items.size[p % len(items.ids)]:
            spans[-1][2] = s
        else:
            spans.append([p, s, s])
    for p, s, t in spans:
        r, i = divmod(p, len(items.ids))
        m = int(items.size[i])
        e = int(_edits(m))
        a, b = max(int(word_off[r]), s - e), min(int(word_off[r + 1]), t + m + e)
        for d, x, y in sorted(stretches(items.words[i], words[a:b], e), key=lambda f: f[1]):
            yield r, i, d, a + x - int(word_off[r]), a + y - int(word_off[r])


def _blocks(benchmark: DataFrame):
    """The items as ``Items`` of a bounded size."""
    block: list = []
    chars = 0
    for r in with_only(benchmark, "item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(r.text) > BLOCK_CHARS):
            yield load_items(*map(list, zip(*block, strict=True)))
            block, chars = [], 0
        block.append((r.item_id, r.text))
        chars += len(r.text)
    if block:
        yield load_items(*map(list, zip(*block, strict=True)))


def _found(batches, items: Items):
    """Slices of the batches with their matches."""
    for batch in batches:
        low = batch.set_column(batch.schema.get_field_index("text"), "text", lowered(batch.column("text")))
        start = 0
        for part, data, off in chunks([low]):
            s, e, word_off = words_of(data, off, _SEP)
            yield batch.slice(start, part.num_rows), list(matches(word_hashes(data, s, e), word_off, items))
            start += part.num_rows


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start_word, end_word) for each stretch that an item matches."""
    spark = docs.sparkSession
    d = with_only(docs, "doc_id", "text")
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def passed(shared):
        def run(batches):
            items = shared.value
            for part, got in _found(batches, items):
                if got:
                    ids = part.column("doc_id").to_pylist()
                    cols = [[ids[g[0]] for g in got], [items.ids[g[1]] for g in got], [g[2] for g in got], [len(items.words[g[1]]) for g in got], [g[3] for g in got], [g[4] for g in got]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        return d.mapInArrow(run, SCHEMA)

    out, shared = None, None
    for items in _blocks(benchmark):
        if out is not None:  # one block at a time: what there is is stored
            out = stored(out, "matches").df
            shared.destroy()
        shared = spark.sparkContext.broadcast(items)
        out = passed(shared) if out is None else out.union(passed(shared))
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; each row is judged by its own text, without an exchange."""
    spark, shared = docs.sparkSession, None

    def passed(docs, shared):
        def run(batches):
            items = shared.value
            for part, got in _found(batches, items):
                ok = np.ones(part.num_rows, bool)
                ok[[g[0] for g in got]] = False
                yield part.filter(pa.array(ok))

        return docs.mapInArrow(run, docs.schema)

    for items in _blocks(benchmark):
        if shared is not None:
            docs = stored(docs, "clean").df
            shared.destroy()
        shared = spark.sparkContext.broadcast(items)
        docs = passed(docs, shared)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of ``documents`` that match an item of ``benchmark``."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
