"""Operators against brute force on small fixtures, and the defined results of edge cases."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from dotloom.llm import decontam, jaccard, quality, queries, substring, suffixes, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, h0 string, starts string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    near = [" ".join(w if rng.random() > 0.01 else word() for w in base[0].split()) for _ in range(12)]
    share = " ".join(word() for _ in range(60))
    mixed = [" ".join(word() for _ in range(30)) + " " + share + " " + " ".join(word() for _ in range(20)) for _ in range(3)]
    texts = [*base, *near, *mixed, base[3], base[3], "", None, "one two", "one two", "x " * 3000, share + " " + share]
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(texts)] + [(None, base[4], "a", "b", "c"), (5, texts[5], "a", "b", "c")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(t):
    return (t or "").split()


def test_substring_equals_brute(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = {}
    for i, t in rows:
        for k in range(len(words(t)) - 12):
            if i is not None:
                first[tuple(words(t)[k : k + 13])] = min(i, first.get(tuple(words(t)[k : k + 13]), i))
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(map(tuple, substring.remove_repeats(docs).collect()), key=str) == sorted(want, key=str)


def test_substring_judges_each_row_of_a_shared_id(spark, monkeypatch):
    monkeypatch.setattr(substring, "GROUP", 50)
    z, own = [" ".join(f"{c}{k}" for k in range(40)) for c in "zo"]
    loop = "a b " * 40
    rows = [(1, z), (2, z), (2, own), (2, "x " + z), (3, z + " " + z), (3, z + " " + z), (4, loop), (5, "c " + loop), (None, z), (6, "w " * 60_000)]
    got = sorted(map(tuple, substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=str)
    want = [(1, 40, 0, z), (2, 40, 40, ""), (2, 40, 0, own), (2, 41, 40, "x"), (3, 80, 80, ""), (3, 80, 80, ""), (4, 80, 0, loop.strip()), (5, 81, 80, "c"), (None, 40, 0, z), (6, 60_000, 0, ("w " * 60_000).strip())]
    # 3 keeps the windows across its two halves, but every word lies in a removed one as well.
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(c.sql(f"SELECT {','.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=str)


def test_passages_equal_brute(spark, docs):
    d = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    seen, want, got = {}, set(), set()
    for r in d.collect():
        for k in range(len(words(r.text)) - 49):
            seen.setdefault(tuple(words(r.text)[k : k + 50]), []).append((r.doc_id, k))
    for at in seen.values():
        if len(at) > 1:
            want |= {(i, j) for i, k in at for j in range(k, k + 50)}
    for r in suffixes.repeats(d).collect():
        got |= {(r.doc_id, j) for j in range(r.start_word, r.end_word)}
    assert got == want


def test_classes_equal_brute(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.where("doc_id IS NOT NULL").collect()]

    def sets(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    label = {i: i for i, _ in rows}
    for _ in rows:
        for i, t in rows:
            for j, u in rows:
                a, b = sets(t), sets(u)
                if t == u or (a & b and len(a & b) >= 0.8 * len(a | b)):
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in label):
            break
    out = jaccard.classes(docs).collect()
    assert len(out) == len(rows) + 1
    assert {(r.doc_id, r.class_id) for r in out if r.doc_id is not None} == set(label.items())


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_passages_behind_a_frequent_line_equal_brute(spark, batch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    texts = []
    for line, own in ((some(30), 20), (some(40), 12), (some(30), 25)):
        texts += [some(25) + line + some(30) for _ in range(400)]
        for _ in range(40):
            behind = some(own)
            texts += [some(20) + line + behind + some(20) for _ in range(2)]
    rng.shuffle(texts)
    seen, want, got = {}, set(), set()
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            seen.setdefault(tuple(t[k : k + 50]), []).append((i, k))
    for at in seen.values():
        if len(at) > 1:
            want |= {(i, j) for i, k in at for j in range(k, k + 50)}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for r in suffixes.repeats(d).collect():
            got |= {(r.doc_id, j) for j in range(r.start_word, r.end_word)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert got == want and len({i for i, _ in want}) == 240


@pytest.mark.parametrize("block", [jaccard.BLOCK, 24])
def test_hub_and_spokes_are_one_class_with_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    hub = [word() for _ in range(120)]
    texts = []
    for k in range(100):
        w = list(hub)
        for p in (rng.randrange(5, 50), rng.randrange(60, 115)) if k != 50 else ():
            w[p] = word()
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(116)} for w in map(str.split, texts)]
    linked = [[i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert sum(map(sum, linked)) < 0.7 * 100 * 99
    got = {r.doc_id: r for r in jaccard.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert {r.class_id for r in got.values()} == {0}
    # Pairs close to the threshold share a band with a probability of 0.999 at least.
    n, all_links = sum(r.n_links for r in got.values()), sum(map(sum, linked))
    assert all(got[i].n_links <= sum(x) for i, x in enumerate(linked)) and n >= 0.995 * all_links


def test_rows_of_one_id_and_different_texts_are_classes_of_their_own(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    a, b, c = ([word() for _ in range(100)] for _ in range(3))
    near = " ".join([*b[:-1], word()])
    a, b, c = map(" ".join, (a, b, c))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "x"), (1, c, "x"), (2, near, "x"), (3, a, "x"), (4, None, "x"), (5, "", "x"), (None, a, "x"), (6, "w " * 50_000, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(d).collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 1, 1), (1, 1, 1), (1, 1, 0), (2, 1, 1), (3, 1, 0), (4, 4, 0), (5, 4, 0), (None, None, 0), (6, 6, 0)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.first_of_each(d).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (1, c), (4, None), (6, "w " * 50_000), (None, a)], key=str)


@pytest.mark.parametrize("name", ["variants", "chain"])
def test_clusters_are_one_class(spark, name):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = []
    if name == "variants":
        for _ in range(120):
            w = list(base)
            for p in rng.sample(range(200), 3):
                w[p] = word()
            texts.append(" ".join(w))
    else:
        w = list(base)
        for _ in range(60):
            w = [*w[12:], *[word() for _ in range(12)]]
            texts.append(" ".join(w))
    order = list(range(len(texts)))
    rng.shuffle(order)
    sets = [{tuple(t[i : i + 5]) for i in range(196)} for t in map(str.split, texts)]
    link = [[len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets]
    want = list(range(len(texts)))
    for _ in want:
        want = [min(want[j] for j in range(len(texts)) if link[i][j]) for i in range(len(texts))]
    got = {r.doc_id: r.class_id for r in jaccard.classes(spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)).collect()}
    classes, parts = {}, {}
    for i, c in enumerate(want):
        classes.setdefault(c, set()).add(order[i])
    for i, c in got.items():
        parts.setdefault(c, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, parts.values()))


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((8, 15, 25, 40, 60, 3))] + [(9, None), (10, "")]
    rows, want = [(500, None), (501, ""), (502, " ".join(word() for _ in range(300)))], set()
    for k, t in items[:5]:
        for c in range(8):
            w = t.split()
            for p in rng.sample(range(len(w)), int(0.1 * len(w))):
                w[p] = word() if c % 2 else ""
            rows.append((k * 10 + c, " ".join([word() for _ in range(20)] + w + [word() for _ in range(20)]).upper()))
            want.add((k * 10 + c, k))
    out = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert all(r.distance <= 0.2 * r.item_words for r in out)


def test_decontamination_finds_all_items_at_the_edit_bound(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate([5, 10, 15, 40, 60, 120, 120, 200])]

    def least(a, b):
        d = [0] * (len(b) + 1)
        for i, w in enumerate(a):
            new = [i + 1]
            for j, x in enumerate(b):
                new.append(min(d[j] + (w != x), d[j + 1] + 1, new[j] + 1))
            d = new
        return min(d)

    rows, want = [], {}
    for k, w in items:
        for c in range(15):
            t, e = list(w), len(w) // 5
            for p in sorted(rng.sample(range(len(t)), e), reverse=True):
                kind = "sub" if c < 10 else rng.choice(["sub", "del", "ins"])
                t[p : p + 1] = [word()] if kind == "sub" else [] if kind == "del" else [t[p], word()]
            text = [word() for _ in range(15)] + t + [word() for _ in range(15)]
            if (d := least(w, text)) <= e:
                want[len(rows), k] = d
            rows.append((len(rows), " ".join(text)))
    assert len(want) == len(rows)
    out = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in out} == want


def test_decontamination_gives_each_repeat_of_an_item(spark):
    item = [f"w{k}" for k in range(12)]
    edited = [*item[:5], "other", *item[6:]]
    text = ["x"] * 3 + item + item + edited + ["y"] * 2 + item + ["z"] * 40 + item
    d = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(item))], "doc_id long, text string")
    out = decontam.contaminated(d, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.distance) for r in out) == [(1, 3, 15, 0), (1, 15, 27, 0), (1, 27, 39, 1), (1, 41, 53, 0), (1, 93, 105, 0), (2, 0, 12, 0)]


def test_alignment_is_the_least_edit_distance():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64) for _ in range(2))
        d = [[0] * (len(b) + 1)] + [[i + 1] + [0] * len(b) for i in range(len(a))]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = min(d[i][j] + int(a[i] != b[j]), d[i][j + 1] + 1, d[i + 1][j] + 1)
        assert decontam.align(a, b)[0] == min(d[-1])


def test_maximal_segments_hold_the_best_sum():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 30)
        hit = {k: rng.choice([0.6, 1.5, 3.0]) for k in range(n) if rng.random() < 0.25}
        s = [hit.get(k, -0.5) for k in range(n)]
        best = max([sum(s[i:j]) for i in range(n) for j in range(i + 1, n + 1)])
        found = toxicity.segments(sorted(hit.items()), -0.5, n)
        assert max((x for _, _, x in found), default=-0.5) == pytest.approx(best)
        assert all(sum(s[a:b]) == pytest.approx(x) for a, b, x in found)


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    r = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").selectExpr(f"avg(CAST(predicted = {label} AS int)) AS a").first()
    assert r.a >= least


def test_rare_significant_words_enter_the_lexicon(spark):
    rng = random.Random(8)
    ids = [i for i in range(26_000) if zlib.crc32(str(i).encode()) % 5][:20_000]
    rows = [[i, " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(6)), int(k < 3000)] for k, i in enumerate(ids)]
    for r in rows[:8] + rows[-1:]:
        r[1] += " zzrareword"
    m = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert m is not None and "zzrareword" in m.words


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (substring.remove_repeats(d), suffixes.repeats(d), jaccard.classes(d), decontam.contaminated(d, spark.createDataFrame([], "item_id long, text string")), quality.score(d, quality.fit(d, lab)), toxicity.score(d, toxicity.fit(d, lab))):
        assert df.count() == 0


def test_each_stage_equals_brute(spark, tmp_path):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    items = [some(12), some(30)]
    rows, toxic = [], []
    for k in range(1400):
        bad = k % 4 == 0
        t = some(30)
        if bad:
            t[3:9] = ["vilest", "nastiest", "hatefully"] * 2
        toxic.append(bad)
        rows.append(t)
    for k in range(1, 400, 8):  # near copies of clean documents, one word changed at the end; some are exact
        rows.append([*rows[k][:-1], word() if k % 16 == 1 else rows[k][-1]])
        toxic.append(False)
    for k in range(3, 400, 8):
        item = list(items[k % 16 == 3])
        for p in rng.sample(range(len(item)), len(item) // 5):
            item[p] = word()
        rows[k][10:10] = item
    for k in range(5, 400, 8):
        rows[k][7:7] = [f"mail u{k}@host.example or 10.0.{k % 250}.7"]
    docs = [(i, " ".join(t)) for i, t in enumerate(rows)] + [(None, "vilest nastiest without an id"), (None, "calm words without an id"), (None, " ".join(["item without an id", *items[0]]))]
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def distance(a, b):
        d = [0] * (len(b) + 1)
        for i, w in enumerate(a):
            new = [i + 1]
            for j, x in enumerate(b):
                new.append(min(d[j] + (w != x), d[j + 1] + 1, new[j] + 1))
            d = new
        return min(d)

    def first_copies(now):
        label, sets = {i: i for i, _ in now if i is not None}, {i: grams(t) for i, t in now if i is not None}
        at = {}
        for i, x in sets.items():
            for g in x:
                at.setdefault(g, []).append(i)
        links = {(i, j) for x in at.values() for i in x for j in x if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        for _ in now:
            for i, j in links:
                label[i] = label[j] = min(label[i], label[j])
        return [(i, t) for i, t in now if i is None or label[i] == i]

    rules = {
        "toxicity": lambda now: [(i, t) for i, t in now if not ("vilest" in t if i is None else toxic[i])],
        "near_copies": first_copies,
        "decontamination": lambda now: [(i, t) for i, t in now if all(distance(x, re.findall("[a-z0-9]+", t)) > len(x) // 5 for x in items)],
        "pii": lambda now: [(i, re.sub(r"10\.0\.[0-9]+\.7", "[IP]", re.sub(r"u[0-9]+@host\.example", "[EMAIL]", t))) for i, t in now],
        "sentencepiece": lambda now: now,
    }
    want, got = docs, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        n = len(want)
        stage(spark, got, str(tmp_path)).write.parquet(f"{tmp_path}/stage-{name}")
        want, got = rules[name](want), spark.read.parquet(f"{tmp_path}/stage-{name}")
        assert len(want) < n or name in ("pii", "sentencepiece")
        if name == "sentencepiece":
            digests = [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want]
            assert sorted(((r.doc_id, r.decoded_sha256) for r in got.collect()), key=str) == sorted(digests, key=str)
            continue
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str), name
        if name == "pii":
            assert all(r.n_chars == len(r.text) for r in got.collect())


def test_pipeline_keeps_clean_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.6 * n < out.count() < n
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "sentencepiece"]
