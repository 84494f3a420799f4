import math

import numpy as np
import pytest

from loomline.llm import toxicity as T


def by_force(rows, j, model, anchor, rounds):
    """Expectation maximisation document by document, in plain Python."""
    fires, speaks, prior = [list(x) for x in model.fires], list(model.speaks), model.prior
    corr = [[0.0] * j for _ in range(j)]
    f0, s0, p0 = [x[:] for x in fires], speaks[:], prior
    for _ in range(rounds):
        weight, spoke, first, second = [0.0, 0.0], [0.0, 0.0], [[0.0] * j for _ in range(2)], [[[0.0] * j for _ in range(j)] for _ in range(2)]
        for mask, gold, n in rows:
            v = [mask >> k & 1 for k in range(j)]
            logit = math.log(prior / (1 - prior))
            if any(v):
                for k in range(j):
                    if v[k]:
                        shared = 1 + sum(max(0.0, corr[k][m]) * v[m] for m in range(j))
                        p = [min(max(f[k], 1e-4), 1 - 1e-4) for f in fires]
                        logit += math.log(p[1] / p[0]) / shared
            else:
                silent = [math.log(1 - min(max(s, 1e-3), 1 - 1e-3)) for s in speaks]
                logit += silent[1] - silent[0]
            logit += {1: 1, 0: -1}.get(gold, 0) * math.log(T.GOLD / (1 - T.GOLD))
            q = 1 / (1 + math.exp(-min(max(logit, -30), 30)))
            for c, w in ((0, n * (1 - q)), (1, n * q)):
                weight[c] += w
                spoke[c] += w * any(v)
                for k in range(j):
                    first[c][k] += w * v[k]
                    for m in range(j):
                        second[c][k][m] += w * v[k] * v[m]
        fires = [[(first[c][k] + anchor[c] * f0[c][k]) / (weight[c] + anchor[c]) for k in range(j)] for c in (0, 1)]
        speaks = [(spoke[c] + anchor[c] * s0[c]) / (weight[c] + anchor[c]) for c in (0, 1)]
        prior = min(max((weight[1] + p0 * sum(anchor)) / (sum(weight) + sum(anchor)), 0.005), 0.5)
        corr = [[0.0] * j for _ in range(j)]
        for c in (0, 1):
            mean = [x / max(weight[c], 1e-9) for x in first[c]]
            cov = [[second[c][k][m] / max(weight[c], 1e-9) - mean[k] * mean[m] for m in range(j)] for k in range(j)]
            sd = [math.sqrt(max(cov[k][k], 1e-9)) for k in range(j)]
            for k in range(j):
                for m in range(j):
                    corr[k][m] += weight[c] / sum(weight) * cov[k][m] / (sd[k] * sd[m]) * (k != m)
    return fires, speaks, prior, corr


def model(j):
    return T.LabelModel(np.arange(j), np.ones(j, int), 0.1, np.stack([np.linspace(0.02, 0.1, j), np.linspace(0.3, 0.6, j)]), np.array([0.2, 0.8]))


@pytest.mark.parametrize("few", [10**6, 3])
def test_rounds_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(T, "FEW_MASKS", few)
    rng = np.random.default_rng(4)
    rows = {}
    for _ in range(400):
        toxic = rng.random() < 0.2
        v = rng.random(5) < (0.5 if toxic else 0.08)
        v[1] = v[0] if rng.random() < 0.8 else v[1]  # voters that repeat each other
        gold = None if rng.random() < 0.5 else int(toxic)
        key = (int(sum(int(x) << k for k, x in enumerate(v))), gold)
        rows[key] = rows.get(key, 0) + 1
    rows = [(m, g, n) for (m, g), n in rows.items()]
    df = spark.createDataFrame(rows, "mask long, gold int, n long").repartition(3)
    anchor = np.array([12.0, 4.0])
    monkeypatch.setattr(T, "SETTLED", 0.0)
    got = T.fit_label_model(df, model(5), anchor, 4)
    fires, speaks, prior, corr = by_force(rows, 5, model(5), anchor.tolist(), 4)
    assert np.allclose(got.fires, fires) and np.allclose(got.speaks, speaks) and abs(got.prior - prior) < 1e-9
    assert np.allclose(got.correlation, corr) and got.correlation[0, 1] > 0.3


def test_no_document(spark):
    none = spark.createDataFrame([], "mask long, gold int, n long")
    got = T.fit_label_model(none, model(2), np.array([1.0, 1.0]), 3)
    assert np.allclose(got.fires, model(2).fires) and got.prior == pytest.approx(0.1)


def test_the_linear_fit_is_at_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.poisson(0.4, (300, 8)).astype(np.float32)
    p = 1 / (1 + np.exp(-(x @ rng.normal(size=8) - 1)))
    w = T.fit_linear(x, p, 0.3, 3000)
    x1 = np.hstack([x, np.ones((300, 1))])
    grad = x1.T @ (1 / (1 + np.exp(-(x1 @ w))) - p) + np.append(np.full(8, 0.3), 0) * w
    assert np.abs(grad).max() < 1e-3
