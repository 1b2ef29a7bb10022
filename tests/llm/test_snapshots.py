"""Snapshot difference against a plain version; nulls, repeats, ties, hot contents, empty tables."""

import hashlib
import random
from collections import defaultdict

import pytest

from dotloom.llm import snapshots
from dotloom.llm.snapshots import difference, later_snapshot

SCHEMA = "doc_id long, text string, lang string, source string, old string, side int"


def plain(earlier, later):
    """What ``difference`` defines, over lists of (key, text, lang, source)."""

    def order(row):  # Spark's order of structs: nulls first
        return [(x is not None, x if i else hashlib.sha256(x.encode()).digest()) if x is not None else (False, b"") for i, x in enumerate(row[1:])]

    def keyed(rows):
        groups = defaultdict(list)
        for r in rows:
            if r[0] is not None:
                groups[r[0]].append(r)
        return {k: (min(v, key=order), len(v)) for k, v in groups.items()}, [(r, 1) for r in rows if r[0] is None]

    (e, e_none), (l, l_none) = keyed(earlier), keyed(later)
    out = []

    def give(o, n, op, o_n, n_n):
        changed = ",".join(c for i, c in enumerate(("text", "lang", "source"), 1) if o[i] != n[i]) if o and n else ""
        op = op or ("update" if changed else "same")
        digest = hashlib.sha256("\n".join("~" if x is None else x for x in n[1:]).encode()).hexdigest() if n else None
        out.append((n[0] if n else o[0], o[0] if o else None, op, changed, digest, o_n, n_n))

    for k in e.keys() & l.keys():
        give(e[k][0], l[k][0], None, e[k][1], l[k][1])
    sides = []
    for rows, none, sign, other in ((e, e_none, 1, l), (l, l_none, -1, e)):
        groups = defaultdict(list)
        for r in [v for k, v in rows.items() if k not in other] + none:
            groups[r[0][1:3]].append(r)
        for g in groups.values():
            g.sort(key=lambda r: (r[0][0] is not None, sign * (r[0][0] or 0), r[0][3] is not None, r[0][3] or ""))
        sides.append(groups)
    for c in sides[0].keys() | sides[1].keys():
        a, b = sides[0].get(c, []), sides[1].get(c, [])
        for i in range(max(len(a), len(b))):
            o, n = (a[i] if i < len(a) else None), (b[i] if i < len(b) else None)
            give(o and o[0], n and n[0], "rekey" if o and n else "delete" if o else "insert", o[1] if o else 0, n[1] if n else 0)
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("blocks", [1, 3, 128])
def test_difference_equals_a_plain_version(spark, monkeypatch, blocks):
    monkeypatch.setattr(snapshots, "BLOCKS", blocks)
    rng = random.Random(blocks)
    texts, langs = [None, "", "a", "b", "a+", "é\nx", "long " * 30_000], [None, "de", "en"]

    def rows(n):
        return [(rng.choice([None, *range(-40, 40), 2**62, -(2**63)]), rng.choice(texts), rng.choice(langs), rng.choice(langs)) for _ in range(n)]

    for n, m in ((120, 120), (40, 200), (0, 30), (30, 0), (0, 0)):
        e, l = rows(n), rows(m)
        # A third of all rows has one content.
        e += [(1000 + i, "hot", "en", rng.choice(langs)) for i in range(n // 2)]
        l += [(-1000 - i, "hot", "en", rng.choice(langs)) for i in range(m // 2)]
        got = difference(frame(spark, e), frame(spark, l))
        assert got.columns == ["key", "old_key", "op", "changed", "row_sha256", "old_rows", "new_rows"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(e, l)


def test_other_columns_and_contents(spark):
    a = spark.createDataFrame([(1, 1.5, None), (2, 2.5, "x"), (3, 2.5, "y")], "id int, price double, name string")
    b = spark.createDataFrame([(1, 1.5, "z"), (9, 2.5, "q"), (8, 2.5, "y")], "id int, price double, name string")
    got = difference(a, b, key="id", columns=("price", "name"), content=("price",), long=())
    assert sorted(map(tuple, got.select("key", "old_key", "op", "changed").collect())) == [(1, 1, "update", "name"), (8, 3, "rekey", ""), (9, 2, "rekey", "name")]


def test_later_snapshot_at_nulls(spark):
    d = spark.createDataFrame([(None, "t", "a", "b"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, later_snapshot(d).collect()), key=str) == sorted([(None, "t", "a", "b"), (None, None, None, None)], key=str)


def test_the_plan_has_no_join(spark, monkeypatch):
    d = frame(spark, [(1, "a", "b", "c")])
    plan = snapshots.ranked(snapshots.by_key(d, d, "doc_id").select(snapshots.F.lit(0).alias("side"), snapshots.F.col("key").alias("ord"), "key"), ["key"])._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan
