"""Words that fool polynomial hashes modulo a power of two: the Thue-Morse word and its complement."""

import duckdb
import numpy as np
import pytest
import sentencepiece

from dotloom.llm import common, decontam, jaccard, spiece, substring, suffixes


def _pair(n=1024):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 512, 1024, 4096])
def test_words_and_windows_differ(n):
    pair = _pair(n)
    data = np.frombuffer(" ".join(pair).encode(), np.uint8)
    starts, ends, _ = common.words_of(data, np.array([0, len(data)]))
    for which in (0, 1):
        assert len(set(common.word_hashes(data, starts, ends, which).tolist())) == 2
    # The same order of two words, as windows and as spans.
    words = [np.where(np.frombuffer(t.encode(), np.uint8) == 97, np.uint64(5), np.uint64(1 << 40)) for t in pair]
    assert common.window_hashes(words[0], n)[0] != common.window_hashes(words[1], n)[0]
    both = common.span_hashes(np.concatenate(words), np.array([0, n]), np.array([n, 2 * n]))
    assert both[0] != both[1]


def test_spans_hash_by_content_alone():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 40)).astype(np.uint8)) for _ in range(300)]
    text = b" ".join(words * 2)
    data = np.frombuffer(text, np.uint8)
    h = common.word_hashes(data, *common.words_of(data, np.array([0, len(data)]))[:2]).tolist()
    assert h[:300] == h[300:] and len(set(h)) == len(set(words))
    for n in (1, 2, 5, 10, 13, 40):
        w = common.window_hashes(np.array(h, np.uint64), n).tolist()
        assert len(w) == 601 - n and w[: 301 - n] == w[300:] and len(set(w)) == len({tuple(h[i : i + n]) for i in range(601 - n)})


def test_operators_tell_the_pair_apart(spark):
    t, u = _pair()
    tail = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{t} {tail}"), (2, f"{u} {tail}"), (3, f"{t} {tail}")], "doc_id long, text string")
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = sorted(map(tuple, substring.remove_repeats(docs, digest=True).select(*cols).collect()))
    with duckdb.connect() as con:
        con.register("documents", docs.toPandas())
        assert got == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({substring.OP8_SQL})").fetchall())
    short = spark.createDataFrame([(1, f"{t} b c d e"), (2, f"{u} b c d e"), (3, f"{t} b c d e ")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.classes(short).collect())) == [(1, 1, 1), (2, 2, 0), (3, 1, 1)]
    texts = [f"{t} x", f"{u} x", t + u, u + t]
    ids, off = spiece.Encoder(spiece.load_model()).encode(texts)
    lib = sentencepiece.SentencePieceProcessor(model_file=spiece.DEFAULT_MODEL)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [lib.encode(x) for x in texts]
    own = [" ".join(w if i == 30 else f"x{i}" for i in range(61)) for w in (t, u)]
    assert not suffixes.repeats(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).count()
    items = spark.createDataFrame([(1, f"{t} {t} {t} {tail}")], "item_id long, text string")
    hits = decontam.contaminated(spark.createDataFrame([(1, f"{u} {u} {u} {tail.replace('w', 'v')}"), (2, f"{t} {t} {t} {tail}")], "doc_id long, text string"), items)
    assert {r.doc_id for r in hits.collect()} == {2}
