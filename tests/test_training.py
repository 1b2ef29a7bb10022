"""Training: gradients against finite differences, the loop against plain numpy, resuming, early stop, edges."""

import os
from dataclasses import replace

import numpy as np
import pytest

from dotloom.operators import sums
from dotloom.operators import training as T

HEADS = [
    T.Config(head="cosine", proj_dim=5, layers=2, lambda_align=0.3, smoothing=0.1),
    T.Config(head="linear", proj_dim=6, layers=3, focal_gamma=2.0, lambda_align=0.2),
    T.Config(head="linear", proj_dim=5, layers=1, dropout=0.0, lambda_align=0.0),
    T.Config(head="margin", proj_dim=5, layers=2, scale=6.0, margin=0.3, dropout=0.4),
    T.Config(head="margin", proj_dim=5, layers=1, scale=6.0, margin_type="cos"),
    T.Config(head="hybrid", proj_dim=5, layers=2, closed_classes=3, alpha=0.3),
    T.Config(head="hybrid", proj_dim=5, layers=2, open_branch="margin", scale=5.0, focal_gamma=1.5),
]


def _data(rng, n, dim, classes):
    return rng.normal(size=(n, dim)), rng.integers(0, classes, n), rng.random(n) * (rng.random(n) > 0.2), rng.integers(0, 2, n).astype(float)


def _total(w, config, t, data, cw, ids, step):
    s, _ = T.gradients(w, config, t, *data, cw, ids, step)
    return s[1] + config.lambda_count * s[2] + config.lambda_align * s[3]


@pytest.mark.parametrize("config", HEADS, ids=lambda c: f"{c.head}-{c.layers}-{c.margin_type}-{c.focal_gamma}")
def test_gradients_equal_finite_differences(config):
    rng = np.random.default_rng(5)
    dim, classes, n = 4, 4, 9
    t, cw, ids = rng.normal(size=(classes, config.proj_dim)), rng.random(classes) + 0.5, np.arange(n) * 7
    w, data = T.initial(config, dim, classes), _data(rng, n, dim, classes)
    _, grads = T.gradients(w, config, t, *data, cw, ids, 3)
    assert set(grads) == set(w)
    for name, v in w.items():
        for at in list(np.ndindex(np.shape(v)))[:12]:
            both = []
            for h in (1e-5, -1e-5):
                x = np.array(v, float)
                x[at] += h
                both.append(_total({**w, name: x}, config, t, data, cw, ids, 3))
            assert grads[name][at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=2e-5, abs=2e-7), (name, at)


def _frame(spark, data, first=0):
    z, y, weight, countable = data
    rows = [(first + i, z[i].tolist(), int(y[i]), float(weight[i]) if weight[i] else 0.7, int(weight[i] > 0), float(countable[i]), "x") for i in range(len(y))]
    return spark.createDataFrame(rows, "cand_id long, z array<double>, matched_class long, purity double, valid int, is_countable double, batch string").repartition(3)


def _plain(w, config, t, data, held, cw):
    """Ten epochs of one step each, written out."""
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    out, best = [], (-1.0, None, 0)
    for e in range(config.epochs):
        lr = config.lr * ((e + 1) / config.warmup if e < config.warmup else 0.5 * (1 + np.cos(np.pi * (e - config.warmup) / (config.epochs - config.warmup))))
        s, g = T.gradients(w, config, t, *data, cw, np.arange(len(data[1])), e)
        new = {}
        for k in w:
            x = g[k] / s[0]
            m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x**2
            new[k] = w[k] * (1 - lr * config.weight_decay) - lr * (m[k] / (1 - 0.9 ** (e + 1))) / (np.sqrt(v[k] / (1 - 0.999 ** (e + 1))) + 1e-8)
        w = new
        ok = held[2] > 0
        p = T._scored(w, config, T._unit(t), held[0])[2].argmax(axis=1)
        top = float((p == held[1])[ok].mean())
        if top > best[0]:
            best = (top, w, e + 1)
        out.append((s[1] / s[0], s[2] / s[0], s[3] / s[0], top))
    return best, out


@pytest.mark.parametrize("k", [0, 1, 3, 5])
def test_ten_epochs_equal_a_plain_run(spark, k):
    config = replace(HEADS[k], epochs=10, lr=0.03, warmup=3, weight_decay=0.02)
    rng = np.random.default_rng(k)
    t, cw = rng.normal(size=(4, config.proj_dim)), rng.random(4) + 0.5
    data, held = _data(rng, 60, 6, 4), _data(rng, 40, 6, 4)
    w = T.initial(config, 6, 4)
    got = T.train(_frame(spark, data), t, config, _frame(spark, held, 1000), cw, w)
    best, losses = _plain(w, config, t, data, held, cw)
    assert got.epoch == best[2]
    for name, v in best[1].items():
        assert np.allclose(got.weights[name], v, atol=1e-9), name
    for h, (cls, count, align, top) in zip(got.history, losses, strict=True):
        assert h["L_cls"] == pytest.approx(cls) and h["L_count"] == pytest.approx(count) and h["L_align"] == pytest.approx(align if config.lambda_align else 0) and h["eval_top1"] == pytest.approx(top)


def test_a_broken_run_goes_on_to_the_same_result(spark, tmp_path):
    config = replace(HEADS[5], epochs=5, lr=0.02, batches=3, dropout=0.2)
    rng = np.random.default_rng(9)
    t, data, held = rng.normal(size=(4, 5)), _data(rng, 50, 6, 4), _data(rng, 20, 6, 4)
    args = (_frame(spark, data), t, config, _frame(spark, held, 500))
    whole = T.train(*args)
    folder, epoch, seen = f"file://{tmp_path}/state", T._epoch, []

    def broken(state, *rest):
        if state.epoch == 3 and not seen:
            seen.append(1)
            raise RuntimeError("lost")
        epoch(state, *rest)

    with pytest.MonkeyPatch.context() as p:
        p.setattr(T, "_epoch", broken)
        with pytest.raises(RuntimeError):
            T.train(*args, folder=folder)
        again = T.train(*args, folder=folder)
    assert sorted(x for x in os.listdir(tmp_path / "state") if x.startswith("epoch")) == ["epoch-4", "epoch-5"]
    assert [h["epoch"] for h in again.history] == [1, 2, 3, 4, 5] and again.epoch == whole.epoch
    for name, v in whole.weights.items():
        assert np.allclose(again.weights[name], v, atol=1e-12), name
    again.write(spark, f"file://{tmp_path}/head")
    read = T.Trained.read(spark, f"file://{tmp_path}/head")
    assert read.config == config and read.epoch == again.epoch and read.history == again.history and list(read.weights) == list(again.weights)
    assert all((read.weights[k] == again.weights[k]).all() and read.weights[k].shape == again.weights[k].shape for k in again.weights)


def test_best_else_last_and_early_stop(spark):
    config = T.Config(head="linear", layers=0, epochs=12, lr=0.0, patience=3, lambda_align=0.0)
    rng = np.random.default_rng(2)
    rows = _frame(spark, _data(rng, 20, 3, 3))
    stopped = T.train(rows, np.eye(3), config, rows)  # nothing is learned: the first epoch stays the best
    assert len(stopped.history) == 4 and stopped.epoch == 1 and [h["best"] for h in stopped.history] == [True, False, False, False]
    last = T.train(rows, np.eye(3), replace(config, epochs=3, lr=0.1))
    assert last.epoch == 3 and len(last.history) == 3 and "eval_top1" not in last.history[0]
    table = last.history_table(spark)
    assert table.count() == 3 and table.where("eval_top1 IS NULL").count() == 3
    learned = T.train(rows, np.eye(3), replace(config, epochs=40, lr=0.3, weight_decay=0.0, patience=0), rows)
    assert max(h["eval_top1"] for h in learned.history) > learned.history[0]["eval_top1"]
    out = {r.cand_id: r.class_idx for r in T.scores(rows, learned, np.eye(3)).collect()}
    want = {r.cand_id: r.y for r in T.prepared(rows).where("valid").collect()}
    assert sum(out[i] == y for i, y in want.items()) / len(want) == pytest.approx(max(h["eval_top1"] for h in learned.history))


def test_edges(spark):
    config = T.Config(head="linear", layers=0, epochs=2, lambda_align=0.0)
    schema = "cand_id long, z array<double>, matched_class long, purity double, valid int, is_countable double"
    none = spark.createDataFrame([], schema)
    t = T.train(none, np.eye(3), config, none)
    assert t.epoch == 1 and t.history[0]["eval_n_valid"] == 0 and "L_cls" not in t.history[0]
    odd = spark.createDataFrame([(1, [1.0, 0.0, 0.0], -1, 0.0, 0, None), (2, None, 1, 1.0, 1, 1.0), (None, [0.0, 1.0, 0.0], 2, 0.9, 1, 1.0), (4, [0.0, 1.0, 1.0], None, 0.9, 1, 0.0)], schema)
    assert T.train(odd, np.eye(3), config).history[1]["L_cls"] > 0
    far = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 3, 1.0, 1, 1.0)], schema)
    with pytest.raises(Exception, match="class 3 has no prototype"):
        T.train(far, np.eye(3), config)
    with pytest.raises(ValueError, match="unknown head"):
        T.Config(head="other")
    for bad in ([(0, [1.0]), (2, [1.0])], [(0, [1.0]), (0, [1.0])], []):
        with pytest.raises(ValueError):
            T.prototype_matrix(spark.createDataFrame(bad, "class_idx long, unit array<double>"))
    assert T.prototype_matrix(spark.createDataFrame([(1, [2.0]), (0, [1.0])], "class_idx long, unit array<double>")).tolist() == [[1.0], [2.0]]


def test_class_weights_have_mean_one(spark):
    rows = T.prepared(spark.createDataFrame([(i, [1.0], c, 1.0, 1, 0.0) for i, c in enumerate([0] * 6 + [1] * 2)], "cand_id long, z array<double>, matched_class long, purity double, valid int, is_countable double"))
    w = T.class_weights(rows, 3)
    assert w.mean() == pytest.approx(1) and w[0] * 6 == pytest.approx(w[1] * 2) and w[2] == pytest.approx(w[1] * 2)


def test_sums_of_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(sums, "BLOCK", 10)

    def partial(batches):
        total = None
        for b in batches:
            for i in b.column("id").to_pylist():
                v = np.arange(37.0) * i
                total = v if total is None else total + v
        return total

    assert np.allclose(sums.summed(spark.range(100).repartition(9), partial), np.arange(37.0) * 4950)
    assert sums.summed(spark.range(0), partial) is None
