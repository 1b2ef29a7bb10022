"""Line deduplication against a plain version; the index forwards and backwards; the cuckoo filter."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from dotloom.llm import lines
from dotloom.llm.lines import Cuckoo, LineIndex, drop_lines

BLANK = " \t\n\v\f\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(texts, least, judged=None):
    n = Counter(k for t in (texts if judged is None else judged) for k in {_key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        every = (t or "").split("\n")
        kept = [x for x in every if n[_key(x)] < least]
        out.append((len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def _texts(rng, n):
    pool = ["Cookie notice", " cookie NOTICE\t", "\x0cÉa\r", "éa", "", "  ", "x", "a\x00b", "🙂 line", *[f"line {i}" for i in range(30)]]
    out = [None, "", "\n", "\n\n", "x" * 60_000, "Cookie notice\n" * 20_000]
    return out + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(n)]


def _frame(spark, texts):
    return spark.createDataFrame([(i if i % 9 else None, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, gone string, n_lines int").repartition(4)


def _rows(df):
    return sorted(map(tuple, df.select("n_lines", "n_dropped", "text").collect()))


@pytest.mark.parametrize("least,limit", [(10, 64_000_000), (2, 300), (1, 1)])
def test_dropped_lines_equal_a_plain_version(spark, monkeypatch, least, limit):
    texts = _texts(random.Random(least), 120)
    docs = _frame(spark, texts)
    index = LineIndex(spark, least).insert(docs)
    monkeypatch.setattr(lines.candidates, "__defaults__", (limit,))
    assert _rows(drop_lines(docs, index)) == sorted(plain(texts, least))
    digests = drop_lines(docs, index, digest=True)
    assert Counter(r.kept_sha256 for r in digests.collect()) == Counter(hashlib.sha256(x[2].encode()).hexdigest() for x in plain(texts, least))
    index.drop()


def _state(index):
    return sorted(map(tuple, index.counts.where("docs > 0").select("h0", "h1", "docs").collect())), {r.shard: r["keys"] for r in index.filters.collect()}


def test_deletion_undoes_insertion(spark):
    rng = random.Random(3)
    texts = [_texts(rng, 60) for _ in range(3)]
    a, b, c = (_frame(spark, t) for t in texts)
    index = LineIndex(spark, 4).insert(a)
    first = _state(index)
    index.insert(b)
    second = _state(index)
    index.insert(c)
    assert _rows(drop_lines(a, index)) == sorted(plain(texts[0], 4, sum(texts, [])))
    index.delete(c)
    assert _state(index) == second
    # A later order of deletions gives the counts of what is left.
    assert _rows(drop_lines(c, index)) == sorted(plain(texts[2], 4, texts[0] + texts[1]))
    index.delete(b)
    assert _state(index) == first
    with pytest.raises(ValueError):
        index.delete(c)
    assert _state(index) == first
    index.delete(a)
    assert _state(index) == ([], {})
    assert _rows(drop_lines(a, index)) == sorted(plain(texts[0], 10**9))
    index.drop()


def test_more_keys_than_the_shards_hold(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 8)
    parts = [["\n".join(f"row {j}" for j in range(i * 40, i * 40 + 60)) for i in range(k, k + 6)] for k in (0, 3, 30)]
    index = LineIndex(spark, 1)
    for t in parts:
        index.insert(_frame(spark, t))
    assert index.bits > 4 and sum(r["keys"] for r in index.filters.collect()) == index.frequent().count()
    assert _rows(drop_lines(_frame(spark, parts[1]), index)) == sorted(plain(parts[1], 1))
    index.drop()


def test_empty_tables(spark):
    none = _frame(spark, [])
    index = LineIndex(spark).insert(none)
    assert drop_lines(none, index).count() == 0 and drop_lines(_frame(spark, ["a\nb"]), index).first().text == "a\nb"


@pytest.mark.parametrize("n,buckets", [(0, 16), (50, 16), (64, 16), (90, 16), (100_000, 32_768)])
def test_cuckoo_loses_none_and_deletes_exactly(n, buckets):
    rng = np.random.default_rng(n)
    h0, h1 = (rng.integers(-(2**63), 2**63 - 1, n) for _ in range(2))
    f = Cuckoo(buckets)
    f.insert(h0, h1)
    assert f.contains(h0, h1).all() and int((f.slots != 0).sum()) + len(f.stash) == n
    other = [rng.integers(-(2**63), 2**63 - 1, 10_000) for _ in range(2)]
    assert f.contains(*other).mean() < 0.01
    half = n // 2
    f = Cuckoo(buckets, f.slots.tobytes(), f.stash)
    f.delete(h0[:half], h1[:half])
    assert f.contains(h0[half:], h1[half:]).all() and int((f.slots != 0).sum()) + len(f.stash) == n - half
    f.delete(h0[half:], h1[half:])
    assert not f.slots.any() and not f.stash
