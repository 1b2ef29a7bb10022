"""Defined results at the edges: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names; and plain versions."""

import glob
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

import corpus_pipeline
from dotloom.llm import common, decontam, quality, spiece, suffixes, toxicity

LONG = "word other " * 30_000
TEXTS = [None, "", "plain text here", "plain text here", LONG, "é漢🙂 \x00 x", "a" * 50_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 0.5, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 1, 0.5, "x"), (None, TEXTS[2], 1, 0.5, "x"), (None, None, 1, 0.5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, score double, passages string").repartition(3)


# ---------------------------------------------------------------- quality
def _plain_statistics(t):
    raw = (t or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    pairs, lines = list(zip(words, words[1:], strict=False)), [x for x in raw.split(b"\n") if x]
    share = lambda chars: sum(b in chars for b in raw) / max(len(raw), 1)
    uniq = lambda x: len(set(x)) / len(x) if x else 1.0
    size = [len(w) for w in words]
    return [
        len(raw), len(words), sum(size) / max(len(words), 1), max(size, default=0), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"!#$%&*|~^<>{}[]=+@\\/_"), share(b".,;:?"),
        sum(b >= 128 for b in raw) / max(len(raw), 1), len(lines), len(words) / max(len(lines), 1), uniq(words), uniq(pairs), uniq(lines), sum(s <= 3 for s in size) / max(len(words), 1),
    ]


def test_statistics_equal_a_plain_version(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abC D.9\n\t#é") for _ in range(rng.randrange(60))) for _ in range(200)] + [t for t in TEXTS if t != LONG]
    off = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])])
    got = quality.statistics(np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8), off)
    assert np.allclose(got, [_plain_statistics(t) for t in texts])


def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(8)
    x = rng.random((600, len(quality.STATS)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] < 0.5)).astype(float)
    m = quality.learn(x, y)
    assert 1 <= len(m.rules) <= 60
    want = [1 / (1 + math.exp(-m.bias - sum(w for w, r in m.rules if all((row[k] > b) == above for k, above, b in r)))) for row in x]
    got = [r.s for r in spark.createDataFrame(x.tolist(), ", ".join(f"{s} double" for s in quality.STATS)).select(quality.compiled(m).alias("s")).collect()]
    assert np.allclose(got, want) and np.mean((np.array(got) > 0.5) == y) > 0.97
    one = quality.learn(x, np.ones(600))
    assert not one.rules and 1 / (1 + math.exp(-one.bias)) == pytest.approx(600.5 / 601)


def test_quality_at_the_edges(spark, docs):
    lab = spark.createDataFrame([(i, q) for i in range(40) for q in (0, i % 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    train = spark.createDataFrame([(i, ("good words " if i % 2 else "## 99 ") * (5 + i)) for i in range(40)], "doc_id long, text string")
    m = quality.fit(train, lab)
    got = quality.score(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.n_words == 3}
    assert len(same) == 1
    assert {r.score for r in quality.score(docs, quality.fit(train, lab.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, quality.fit(train, spark.createDataFrame([(None, 1), (7, None)], "doc_id long, quality int"))).collect()} == {0.5}


# ---------------------------------------------------------------- toxicity
def _toxic(spark, n=600):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(20)] + (["vilest", "nastily"] * 2 if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(n)]
    return rows, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_lexicon_equals_plain_counts(spark):
    rows, d, lab = _toxic(spark)
    again = d.union(spark.createDataFrame([(9000 + r[0], r[1]) for r in rows[:50]], "doc_id long, text string"))
    more = lab.union(spark.createDataFrame([(9000 + r[0], 1 - r[2]) for r in rows[:50]], "doc_id long, toxic int"))
    m = toxicity.fit(again, more)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    # Of equal texts the least id's label counts, if that one is in the training fold.
    late = {r[1]: 1 - r[2] for r in rows[:50] if not zlib.crc32(str(r[0]).encode()) % 5 and zlib.crc32(str(9000 + r[0]).encode()) % 5}
    seen = [(r[1], r[2]) for r in train] + list(late.items())
    n1, n0 = sum(y for _, y in seen), sum(1 - y for _, y in seen)
    count = {}
    for t, y in seen:
        have = set(t.split())
        for f in have | {"^" + w[:4] for w in have if len(w) > 4}:
            count.setdefault(f, [0, 0])[1 - y] += 1
    want = {}
    for f, (a, b) in count.items():
        p = (a + b) * toxicity.PRIOR / (n1 + n0) + 0.01
        x, y = a + p, b + p
        odds = math.log(x / (n1 + toxicity.PRIOR + 0.02 - x)) - math.log(y / (n0 + toxicity.PRIOR + 0.02 - y))
        if odds / math.sqrt(1 / x + 1 / y) >= toxicity.LEAST_Z and odds >= toxicity.LEAST_ODDS and a >= 2:
            want[f] = odds
    got = {**m.words, **{"^" + h: o for h, o in m.heads.items()}}
    assert set(got) == set(want) >= {"vilest", "nastily", "^vile"} and all(got[f] == pytest.approx(want[f]) for f in want)


def test_passages_count_together():
    one = toxicity.together(100, [20.0], 1.0)
    assert one == pytest.approx(20 - math.log(100))
    assert toxicity.together(100, [20.0, 19.0], 1.0) > one and toxicity.together(100, [20.0, 5.0], 1.0) == pytest.approx(one)
    assert toxicity.together(0, [], 1.0) == -1.0
    # Two sums: -ln of exp(-T) T / 2, halved once.
    a, b = 20 - math.log(100), 19 - math.log(100)
    assert toxicity.together(100, [19.0, 20.0], 1.0) == pytest.approx(-math.log(math.exp(-a - b) * (a + b) / 2) - math.log(2))


def test_toxicity_at_the_edges(spark, docs):
    _, d, lab = _toxic(spark)
    m = toxicity.fit(d, lab.union(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")))
    bad = spark.createDataFrame([(50, "Vilest nastily VILEST", 1, 0.5, "x"), (50, "Vilest nastily VILEST", 1, 0.5, "x"), (50, "calm words", 1, 0.5, "x"), (None, "vilest nastily vilest", 1, 0.5, "x")], docs.schema)
    every = docs.union(bad)
    got = toxicity.score(every, m).collect()
    assert len(got) == every.count() and all(0 <= r.score <= 1 for r in got)
    assert sorted((r.score >= 0.5, len(r.passages) > 0) for r in got) == [(False, False)] * (docs.count() + 1) + [(True, True)] * 3
    left = toxicity.accepted(every, m)
    assert left.schema == every.schema and left.count() == docs.count() + 1
    assert toxicity.accepted(every.limit(0), m).count() == 0 and toxicity.accepted(every, None).count() == every.count()
    assert toxicity.fit(d, lab.where("toxic = 1")) is None


# ---------------------------------------------------------------- suffixes
def _covered(rows):
    seen, want = {}, {}
    for n, (i, t) in enumerate(rows):
        w = (t or "").split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), []).append((n, k))
    for at in seen.values():
        if len(at) > 1:
            for n, k in at:
                want.setdefault(n, set()).update(range(k, k + 50))
    out = []
    for key in {(i, t): n for n, (i, t) in enumerate(rows)}.items():
        (i, _), n = key
        cover, now = sorted(want.get(n, ())), None
        for p in cover:
            if now and p == now[2]:
                now[2] += 1
            else:
                now = [i, p, p + 1]
                out.append(now)
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_passages_hang_on_the_texts_alone(spark, parts):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    base, share, other = some(220), some(60), some(55)
    rows = []
    for k in range(100):  # edited copies of one text
        w = list(base)
        for p in rng.sample(range(220), 4):
            w[p] = word()
        rows.append((k, " ".join(w)))
    rows += [(None, " ".join(share + some(30))), (None, " ".join(some(30) + other)), (500, " ".join(some(5) + share)), (500, " ".join(other + some(40)))]
    rows += [(600, " ".join(some(80))), (600, rows[-1][1]), (700, " ".join(some(49))), (701, " ".join(share[:49] + some(9))), (702, None), (703, "")]
    rows += [(800, "x y " * 100), (801, " ".join(some(60)))]
    rows.append(rows[-1])  # a row twice
    d = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, at int, key string").repartition(parts)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(2, parts // 3)))
    try:
        got = sorted(map(tuple, suffixes.repeats(d).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    want = [r for r in _covered(rows) if r[0] != 800]
    assert [r for r in got if r[0] != 800] == want
    # A text of one repeated pair is one passage from end to end.
    assert [r for r in got if r[0] == 800] == [(800, 0, 200)]


# ---------------------------------------------------------------- SentencePiece
def test_all_ids_of_a_table_equal_the_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=spiece.DEFAULT_MODEL)
    model = spiece.load_model()
    encoder, decoder = spiece.Encoder(model), spiece.Decoder(model)
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = [t or "" for t in pq.ParquetFile((glob.glob(f"{path}/*.parquet") or [path])[0]).read(columns=["text"]).column(0).to_pylist()]
    texts += [t for t in TEXTS if t is not None] + ["▁▁ x▁y", " " * 40 + "a  b" + " " * 33, "🙂" * 300, "ab\x00cd", "supercalifragilistic" * 40]
    for part in (texts[:400], texts[400:], texts[-9:]):
        ids, off = encoder.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [lib.encode(t) for t in part]
        spaced = [t.replace("▁", " ") for t in part]
        assert [x.decode() for x in decoder.decode(ids, off)] == spaced


def test_a_word_without_encoding_is_merged_plainly(monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=spiece.DEFAULT_MODEL)
    encoder = spiece.Encoder(spiece.load_model())
    text = "some ordinary words and unlikelihood"
    monkeypatch.setattr(encoder, "apart", lambda a, b: np.zeros(len(a), bool))
    ids, off = encoder.encode([text, "a"])
    assert ids[: off[1]].tolist() == lib.encode(text)


def test_round_trip_columns(spark, docs):
    got = spiece.round_trip(docs).collect()
    want = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()]
    assert sorted(((r.doc_id, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_tokens == len(r.token_ids) for r in got)
    tokens = spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")
    assert [r.text for r in spiece.decode(tokens).collect()] == ["", ""]


# ---------------------------------------------------------------- decontamination
def _distance(a, b):
    d = [0] * (len(b) + 1)
    for i, w in enumerate(a):
        new = [i + 1]
        for j, x in enumerate(b):
            new.append(min(d[j] + (w != x), d[j + 1] + 1, new[j] + 1))
        d = new
    return min(d)


def test_contaminated_documents_equal_brute(spark, monkeypatch):
    rng = random.Random(44)
    word = lambda: rng.choice([f"w{k}" for k in range(25)])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([2, 3, 5, 9, 12, 12, 16, 20, 24])] + [(4, None), (None, "q1 q2 q3 q4"), (60, "lone"), (61, "")]
    items.append((62, items[4][1]))  # an item of equal text
    rows = []
    for k in range(150):
        w = [word() for _ in range(rng.randrange(60))]
        if k % 2:
            item = rng.choice(items[2:9])[1].split()
            for p in sorted(rng.sample(range(len(item)), rng.randrange(len(item) // 4 + 1)), reverse=True):
                item[p : p + 1] = rng.choice([[word()], [], [item[p], word()]])
            w[5:5] = item
        rows.append((k if k % 10 else None, " ".join(w), "i", 0))
    rows += [(7, None, "i", 0), (8, "", "i", 0), (9, "Q1, q2! q3-q4", "i", 0), rows[3]]
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 5)
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string, distance int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    best = [[(i, _distance(words(t), words(x))) for i, t in items if len(words(t)) > 1 and _distance(words(t), words(x)) <= len(words(t)) // 5] for _, x, _, _ in rows]
    got, found = {}, decontam.contaminated(d, b).collect()
    for r in found:
        key = (r.doc_id, r.item_id)
        got[key] = min(r.distance, got.get(key, 99))
    want = {}
    for (i, *_), hits in zip(rows, best, strict=True):
        for item, dist in hits:
            want[i, item] = min(dist, want.get((i, item), 99))
    assert set(got) <= set(want) and len(got) >= decontam.RECALL * len(want) and all(got[k] >= want[k] for k in got)
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)
    clean = decontam.clean(d, b)
    assert clean.schema == d.schema
    kept = sorted(((r.doc_id, r.text) for r in clean.collect()), key=str)
    left = sorted(((i, t) for (i, t, *_), hits in zip(rows, best, strict=True) if not hits), key=str)
    assert len(set(kept) - set(left)) <= 0.01 * len(rows) and set(left) <= set(kept)
    assert decontam.clean(d, b.limit(0)).count() == len(rows) and decontam.clean(d.limit(0), b).count() == 0


@pytest.mark.parametrize("m", [10, 25, 60, 150])
def test_recall_of_the_walks_at_the_edit_bound(m):
    rng = np.random.default_rng(m)
    words = rng.integers(1, 1 << 60, m).astype(np.uint64)
    n, hits, e = 200, 0, m // 5
    need = decontam.walks_for(m)
    zero, size = np.zeros(1, np.int64), np.array([m])
    own = decontam.embedded(words, zero, size, size, 0, need)
    for _ in range(n):
        t = words.copy()
        t[rng.choice(m, e, replace=False)] = rng.integers(1, 1 << 60, e).astype(np.uint64)
        hits += (decontam.embedded(t, zero, size, size, 0, need) == own).all(axis=2).any()
    assert hits >= 0.98 * n


# ---------------------------------------------------------------- shared parts
def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(900, 901), (901, 900), (902, 902)], "u long, v long")
    got = {r.node: r.label for r in common.components(edges, "test").df.collect()}
    assert got == {**dict.fromkeys(range(n), 0), 900: 900, 901: 900}


def test_least_hashed_is_a_bounded_sample(spark):
    d = spark.range(10_000)
    a = sorted(r.id for r in common.least_hashed(d, 500, "id").collect())
    assert len(a) == 500 and a == sorted(r.id for r in common.least_hashed(d.repartition(7), 500, "id").collect())
    assert common.least_hashed(d.limit(30), 500, "id").count() == 30 and common.least_hashed(d.limit(0), 5, "id").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


# ---------------------------------------------------------------- pipeline
@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_at_the_edges(spark, tmp_path, empty):
    rows = [(i, t, 0, "x", 1) for i, t in enumerate(TEXTS)] + [(2, "another text under one id", 0, "x", 1), (2, TEXTS[2], 0, "x", 1), (None, TEXTS[2], 0, "x", 1), (None, None, 0, "x", 1)]
    kind = "doc_id long, text string, n_chars long, h0 string, token_ids int"
    d = spark.createDataFrame([] if empty else rows, kind)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert not got
        return
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    # Null and empty texts are one class, repeated texts another; other texts of an id and rows without one stay.
    want = [(0, digest("")), (2, digest(TEXTS[2])), (2, digest("another text under one id")), *[(i, digest(TEXTS[i])) for i in (4, 5, 6)], (None, digest(TEXTS[2])), (None, digest(""))]
    assert sorted(((r.doc_id, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)


def test_gaps_round_trip():
    from dotloom.llm import substring

    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 400, 60_000):
        x = np.sort(rng.choice(65_536, n, replace=False)).astype(np.int64)
        new = np.zeros(n, bool)
        new[:1] = True
        raw, at = substring._gaps(x, new)
        assert len(at) == n + 1 and np.array_equal(substring._ungap(raw.tobytes()), x)
