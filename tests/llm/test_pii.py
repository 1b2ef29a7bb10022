import time
import hashlib
import random
import re

from dotloom.llm import pii

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x * 2 > 9 else x * 2) for i, x in enumerate(d)) % 10 == 0


def brute(t):
    t = t or ""
    num = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in E.finditer(t)],
        "ip": [m.span() for m in I.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in C.finditer(t) if 13 <= len(num(m)) <= 19 and luhn(num(m))],
        "phone": [m.span() for m in P.finditer(t) if 9 <= len(num(m)) <= 15],
    }


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in rows:
        for k, want in brute(t).items():
            assert [(x.s, x.e) for x in got[i][k]] == want, (k, t)


def test_random_texts_equal_plain_regex(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "_d@e.f", "1.2.3.4", "256.1.1.1.", ".", "4111 1111-1111 1111", "5", " ", "-", "+1 (499) 555-6503", "é𝄞", "@", "+", "00", "x", "4532015112830366", "\n", "a-b.c"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(600)]
    check(spark, [*rows, (9001, None), (9002, "")])


def test_long_runs(spark):
    n = 20_000
    check(spark, [(1, "a" * n), (2, "7" * n), (3, "1 " * n), (4, "a@" + "b." * n + "c"), (5, "+1" + "(" * n)])


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
    out = {r.doc_id: r for r in pii.op6_pii(spark, "/root/testdata/sf0.001").collect()}
    for i, t in rows:
        b = brute(t)
        s = ",".join(f"{k}:{x}:{y}" for k in pii.KINDS for x, y in b[k])
        assert out[i].base_sha256 == hashlib.sha256(s.encode()).hexdigest() and out[i].spans.startswith(s)


def test_redaction_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or 1.2.3.4", "x"), (2, None, "y"), (2, "plain", "z")], "doc_id long, text string, email string")
    assert sorted(map(tuple, pii.redact(df).collect()), key=str) == sorted([(1, "mail [EMAIL] or [IP]", "x"), (2, None, "y"), (2, "plain", "z")], key=str)


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keywords_that_are_tokens_themselves_vote(spark):
    texts = ["passport AB1234567", "my password Zx81kq2204", "credential: Zx81kq2204", 'my_api_token = "Zx81kq2204"', "monkeypassport Zx81kq2204", "wordlike2024 Zx81kq2204", "password " + "far " * 8 + "Zx81kq2204"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [x.v.keyword for x in r.cand] for r in pii.with_candidates(pii.with_base(df)).collect()}
    assert got == {0: [1], 1: [1], 2: [1], 3: [1], 4: [0], 5: [0, 0], 6: [0]}
    quoted = {r.doc_id: [x.v.quoted for x in r.cand] for r in pii.with_candidates(pii.with_base(df)).collect()}
    assert quoted[3] == [1] and quoted[2] == [0]


def test_reliabilities_of_simulated_labelers():
    rng = random.Random(12)
    hit, alarm = [0.9, 0.7, 0.8, 0.6, 0.95, 0.75], [0.05, 0.2, 0.1, 0.3, 0.02, 0.15]
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.25
        v = tuple(int(rng.random() < r) for r in (hit if y else alarm))
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, []).append(y)
    prior, h, a, post = pii.reliabilities(counts)
    assert abs(prior - 0.25) < 0.02
    assert all(abs(x - y) < 0.04 for x, y in zip(h + a, hit + alarm, strict=True))
    big = [v for v in counts if counts[v] > 300]
    assert big and all(abs(post[v] - sum(truth[v]) / len(truth[v])) < 0.08 for v in big)


def _planted():
    rng = random.Random(4)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, upper, low = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: pick(low, rng.randrange(3, 9))
    plain = ["version2024", "figure-12a-left", "conference2019", "section-4-overview", "highway101north", "chapter12notes", "windows10pro", "release: candidate", "summer2021edition", "note: something"]
    texts, want = [], []
    for k in range(600):
        w = [word() for _ in range(30)]
        secret = [None, f"AKIA{pick(upper, 16)}", pick(hexa, 18), pick(hexa, 40)][k % 4]
        if secret:
            w[10] = {1: "{}", 2: "password={}", 3: 'token = "{}"'}[k % 4].format(secret)
        for p in rng.sample(range(12, 30), 3):
            w[p] = rng.choice(plain)
        texts.append(" ".join(w))
        want.append(secret)
    return texts, want


def test_planted_secrets_are_told_from_ordinary_tokens(spark):
    texts, want = _planted()
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    hits = {(r.doc_id, texts[r.doc_id][x.s : x.e]) for r in found.collect() for x in r.secret}
    planted = {(i, x) for i, x in enumerate(want) if x}
    assert len(hits & planted) >= 0.95 * len(planted) and len(hits & planted) >= 0.95 * len(hits)
    counts = {tuple(r) for r in pii.with_candidates(pii.with_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).selectExpr("explode(cand.v) AS v").select(*[f"v.{k}" for k in pii.VOTES]).distinct().collect()}
    assert len(counts) >= 5


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\"", 1, "c", "t", "x")], "doc_id long, text string, digit int, cand string, tokens string, row string")
    assert [tuple(r) for r in pii.redact(df).collect()] == [(1, 'token = "[SECRET]"', 1, "c", "t", "x")]


def test_many_spans_in_one_text_take_far_less_than_quadratic_time(spark):
    n, took = 13_000, []
    for k in (n // 10, n):
        text = " ".join(f"a{i}@b.co tok{i}Xx9kq2204 10.0.0.{i % 300}" for i in range(k))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        row = pii.with_candidates(pii.with_base(docs)).selectExpr("size(email) AS e", "size(ip) AS i", "size(cand) AS c").first()
        took.append(time.time() - start)
        assert row.e == k and row.c == k and row.i == sum(i % 300 < 256 for i in range(k))
    assert took[1] < 20 * max(took[0], 1)
    redacted = pii.redact(docs).first().text
    assert redacted.count("[EMAIL]") == n and "@" not in redacted


def test_redaction_equals_plain_replacement_over_many_blocks(spark):
    rng = random.Random(8)
    parts = ["x@y.zz", "+49 30 1234567", "4111 1111 1111 1111", "10.1.2.3", "plain", "é🙂", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(n)) for n in (1, 63, 64, 65, 700)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    redacted = {r.doc_id: r.text for r in pii.redact(d).collect()}
    for row in pii.find(d).collect():
        text = texts[row.doc_id]
        every, at, out = sorted((x.s, x.e, f"[{k.upper()}]") for k in [*pii.KINDS, "secret"] for x in row[k]), 0, ""
        for s, e, k in every:
            if e > at:
                out, at = out + text[at : max(s, at)] + k, e
        assert redacted[row.doc_id] == out + text[at:]
