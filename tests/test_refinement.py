"""Refinement of groups against a plain version; states of merged groups; images of their own."""

import itertools
import math
import random

import numpy as np
import pytest

from dotloom.operators import groups as G

W = G.Weights(noise_below=0.4, complexity=0.2, eps=1e-6)
KW = {"noise_below": 0.4, "complexity": 0.2}


def _cost(ids, p, z, valid, aff):
    share = np.mean([p[i] for i in ids], axis=0)
    centre = np.mean([z[i] for i in ids], axis=0)
    pairs = list(itertools.combinations(sorted(ids), 2))
    return (
        -sum(v * math.log(v) for v in share if v > 0) + (sum(-math.log(aff[q] + 1e-6) if q in aff else -math.log(1e-6) for q in pairs) / len(pairs) if pairs else 0)
        + np.mean([np.linalg.norm(z[i] - centre) for i in ids]) + np.mean([not (valid[i] > 0 and max(p[i]) >= 0.4) for i in ids]) + 0.2
    )


def _components(ids, edges):
    label = {i: i for i in ids}
    for _ in ids:
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    return label


def _plain(groups, p, z, valid, aff, split_least, mixed, loose):
    """Lists of ids of one image, refined."""
    out = []
    for ids in groups:
        share = np.mean([p[i] for i in ids], axis=0)
        entropy = -sum(v * math.log(v) for v in share if v > 0)
        pairs = list(itertools.combinations(sorted(ids), 2))
        inconsistency = sum(-math.log(aff[q] + 1e-6) if q in aff else -math.log(1e-6) for q in pairs) / len(pairs) if pairs else 0
        parts = [list(ids)]
        if entropy > mixed or inconsistency > loose:
            edges = []
            for i in ids:
                near = [(aff[q], -j) for j in ids if j != i and (q := (min(i, j), max(i, j))) in aff]
                if near and max(near)[0] >= split_least:
                    edges.append((i, -max(near)[1]))
            label = _components(ids, edges)
            parts = [[i for i in ids if label[i] == k] for k in sorted(set(label.values()))]
            if not sum(_cost(x, p, z, valid, aff) for x in parts) < _cost(ids, p, z, valid, aff):
                parts = [list(ids)]
        out += parts
    groups, rounds = {min(x): x for x in out}, 0
    while True:
        gains = {}
        for a, b in itertools.combinations(sorted(groups), 2):
            if any((min(i, j), max(i, j)) in aff for i in groups[a] for j in groups[b]):
                gain = _cost(groups[a], p, z, valid, aff) + _cost(groups[b], p, z, valid, aff) - _cost(groups[a] + groups[b], p, z, valid, aff)
                if gain > 1e-9:
                    gains[a, b] = gain
        best = {g: max((v, -(b if g == a else a)) for (a, b), v in gains.items() if g in (a, b)) for g in {x for q in gains for x in q}}
        pairs = [(a, b) for a, b in gains if -best[a][1] == b and -best[b][1] == a]
        if not pairs:
            return {i: g for g, ids in groups.items() for i in ids}, rounds
        rounds += 1
        for a, b in pairs:
            groups[a] += groups.pop(b)


def _image(rng, image, n, dims=3, classes=4):
    ids = [image * 1000 + k for k in range(n)]
    kind = {i: rng.randrange(classes) for i in ids}
    p, z = {}, {}
    for i in ids:
        w = np.array([rng.random() * 0.15 + (0.9 if c == kind[i] else 0) for c in range(classes)])
        p[i], z[i] = w / w.sum(), np.array([rng.gauss(kind[i] * 0.8, 0.25) for _ in range(dims)])
    valid = {i: int(rng.random() > 0.15) for i in ids}
    aff = {(i, j): float(p[i] @ p[j]) * (0.4 + 0.5 * rng.random()) for i, j in itertools.combinations(ids, 2) if rng.random() < 0.7}
    start = [[i for i in ids if i % 5 == r] for r in range(5)]
    return [g for g in start if g], p, z, valid, aff


@pytest.mark.parametrize("seed", [1])
def test_refinement_equals_a_plain_version(spark, seed):
    rng = random.Random(seed)
    images = {k: _image(rng, k, n) for k, n in enumerate((14, 1, 2, 25, 9))}
    members = [(k, i, min(g)) for k, im in images.items() for g in im[0] for i in g]
    features = [(i, im[1][i].tolist(), im[2][i].tolist(), im[3][i]) for im in images.values() for i in im[1]]
    pairs = [(k, i, j, a) for k, im in images.items() for (i, j), a in im[4].items()]
    m = spark.createDataFrame(members, "image_id long, cand_id long, group_id long").repartition(3)
    f = spark.createDataFrame(features, "cand_id long, p array<double>, z array<double>, valid int")
    a = spark.createDataFrame(pairs, "image_id long, i long, j long, affinity double")
    got = {r.cand_id: r.group_id for r in G.refined(m, f, a, 0.3, limits={"most_entropy": 0.9, "most_inconsistency": 0.8}, **KW).collect()}
    want, rounds = {}, 0
    for im in images.values():
        w, r = _plain(*im, 0.3, 0.9, 0.8)
        want, rounds = want | w, max(rounds, r)
    assert got == want and rounds > 1
    # Costs and gains of the first groups.
    cost = {r.group_id: r.cost for r in G.costs(m, f, a, **KW).collect()}
    for im in images.values():
        for g in im[0]:
            assert cost[min(g)] == pytest.approx(_cost(g, *im[1:]))


def test_states_of_merged_groups_are_those_of_their_members(spark):
    im = _image(random.Random(7), 1, 16)
    m = spark.createDataFrame([(1, i, min(g)) for g in im[0] for i in g], "image_id long, cand_id long, group_id long")
    f = spark.createDataFrame([(i, im[1][i].tolist(), im[2][i].tolist(), im[3][i]) for i in im[1]], "cand_id long, p array<double>, z array<double>, valid int")
    a = spark.createDataFrame([(1, i, j, x) for (i, j), x in im[4].items()], "image_id long, i long, j long, affinity double")
    g = G.grouped(m, f, a, W)
    every = G._gains(g, f, W, None).collect()
    some = {(r.a, r.b) for r in G._gains(g, f, W, 1e-9).collect()}
    best = {}
    for r in every:
        for x in (r.a, r.b):
            best[x] = max(best.get(x, (0.0, 0, 0)), (r.gain, r.a, r.b))
    assert {b[1:] for b in best.values() if b[0] > 1e-9} <= some  # what the bounds leave out is nobody's best
    for r in G._joined(g, W).collect():
        away = next(x.away for x in every if (x.a, x.b) == (r.a, r.b))
        assert r.low - 1e-9 <= away <= r.high + 1e-9
    after = G._after(g, G.kept(G._mutual(G._gains(g, f, W, 1e-9), 1e-9)).df)
    again = G.grouped(after.members.df, f, a, W)
    flat = lambda t: sorted((r.group_id, r.n, r.noisy, r.pairs, round(r.loose, 9), round(r.away, 9), [round(v, 9) for v in r.sums]) for r in t.collect())
    assert flat(after.states.df) == flat(again.states.df)
    edges = lambda t: sorted((r.a, r.b, r.pairs, round(r.loose, 9)) for r in t.collect())
    assert edges(after.between.df) == edges(again.between.df)


def test_no_candidates(spark):
    m = spark.createDataFrame([], "image_id long, cand_id long, group_id long")
    f = spark.createDataFrame([], "cand_id long, p array<double>, z array<double>, valid int")
    a = spark.createDataFrame([], "image_id long, i long, j long, affinity double")
    assert G.refined(m, f, a, 0.3).count() == 0


def test_images_without_a_merge_leave_the_rounds(spark, monkeypatch):
    # Image 1 merges two equal candidates, image 2 has none that gain, image 3 has a single.
    m = spark.createDataFrame([(1, 10, 10), (1, 11, 11), (2, 20, 20), (2, 21, 21), (3, 30, 30)], "image_id long, cand_id long, group_id long")
    p, q = [1.0, 0.0], [0.0, 1.0]
    f = spark.createDataFrame([(10, p, p, 1), (11, p, p, 1), (20, p, p, 1), (21, q, q, 1), (30, p, p, 1)], "cand_id long, p array<double>, z array<double>, valid int")
    a = spark.createDataFrame([(1, 10, 11, 0.9), (2, 20, 21, 1e-6)], "image_id long, i long, j long, affinity double")
    rounds, after = [], G._after

    def seen(groups, chosen):
        out = after(groups, chosen)
        rounds.append([sorted({r.image_id for r in t.df.collect()}) for t in (out.members, out.states, out.between)])
        return out

    monkeypatch.setattr(G, "_after", seen)
    got = sorted(tuple(r)[:3] for r in G.refined(m, f, a, 0.5, **KW).collect())
    assert got == [(1, 10, 10), (1, 11, 10), (2, 20, 20), (2, 21, 21), (3, 30, 30)]
    assert rounds == [[[1], [1], []]]
