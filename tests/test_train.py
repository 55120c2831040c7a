"""The distributed classifier against a plain re-statement on dense arrays."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpuslens.operators import train as TR
from corpuslens.plans import subwords


def dense(words, y, weight, is_val, n, min_df, l1, epochs, patience):
    """Accelerated proximal gradient on a dense matrix, all rows in one place."""
    rows = [np.asarray(w, dtype=int) for w in words]
    train = [i for i in range(len(rows)) if not is_val[i]]
    df = np.zeros(n)
    for i in train:
        df[np.unique(rows[i])] += 1
    idf = np.where(df >= min_df, np.log((len(train) + 1) / (df + 1)), 0)
    x = np.zeros((len(rows), n))
    for i, w in enumerate(rows):
        for k in set(w.tolist()):
            x[i, k] = (1 + np.log((w == k).sum())) * idf[k]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    y, weight, val = np.array(y, float), np.array(weight, float), np.array(is_val)
    w, b, z, bz, t, log, best, since = np.zeros(n), 0.0, np.zeros(n), 0.0, 1.0, [], (np.inf, None, None), 0
    for epoch in range(epochs):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        loss = -weight * np.log(np.where(y == 1, p, 1 - p))
        held = loss[val].sum() / weight[val].sum()
        scores = []
        for c in (1, 0):
            hit, true = (p >= 0.5) == c, y == c
            both = (hit & true & val).sum()
            scores.append(2 * both / max(1, (hit & val).sum() + (true & val).sum()))
        log.append((epoch, loss[~val].sum() / weight[~val].sum(), held, np.mean(scores)))
        if held < best[0]:
            best, since = (held, w, b), 0
        else:
            since += 1
        if since > patience:
            break
        r = np.where(val, 0, weight * (1 / (1 + np.exp(-(x @ z + bz))) - y)) / weight[~val].sum()
        step = z - x.T @ r / 0.5
        new, new_b = np.sign(step) * np.maximum(abs(step) - l1 / 0.5, 0), bz - r.sum() / 0.5
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, bz = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return best[1], best[2], log


def labelled(n, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.2)
        words = [f"w{rnd.randint(0, 200)}" for _ in range(rnd.randint(0, 30))] + (["bad"] * rnd.randint(0, 2) if y else [])
        rows.append((i, " ".join(words) if i % 37 else None, y, int(i % 5 == 0), "val" if i % 4 == 1 and i % 5 else "train"))
    return rows


def test_fit_equals_dense_steps_and_stops_on_validation(spark):
    df = spark.createDataFrame(labelled(160), "id long, input string, label int, is_synth int, split string").repartition(5)
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    options = {"n": 512, "min_df": 2, "l1": 0.004, "epochs": 12, "patience": 3}
    model = TR.fit_weighted(train, val, synth_weight=0.3, **options)
    words = {r.id: r.w for r in df.select("id", TR.buckets(F.col("input"), 512).alias("w")).collect()}
    rows = df.collect()
    real = [r for r in rows if r.split == "train" and r.is_synth == 0]
    share = {c: len(real) / (2 * sum(r.label == c for r in real)) for c in (0, 1)}
    weight = [share[r.label] * (0.3 if r.is_synth else 1.0) for r in rows]
    w, b, log = dense([words[r.id] for r in rows], [r.label for r in rows], weight, [r.split == "val" for r in rows], **options)
    assert np.allclose(model.weights, w, atol=1e-9) and abs(model.bias - b) < 1e-9 and (w != 0).sum() > 3
    assert np.allclose(np.array(model.log), np.array(log), atol=1e-9)
    scored = {r.id: r.prob_pos for r in TR.prob_pos(model, df).collect()}
    assert all(0 <= p <= 1 for p in scored.values()) and len(scored) == 160
    assert TR.metric_log(spark, model).count() == len(log)


def test_descent_stops_and_keeps_the_lowest_validation_loss():
    losses = [5.0, 4.0, 3.0, 3.5, 3.6, 3.7, 1.0]
    calls = []

    def one_pass(ahead, now):
        calls.append(now)
        return np.array([1.0, 1.0, 0.0, 1.0, 1.0, losses[len(calls) - 1], 0, 0, 0, 0, 1])

    w, _, log = TR.descend(one_pass, 1, l1=0.0, epochs=7, patience=2)
    assert len(log) == 6 and w is calls[2][0]


def test_registered_classifier_beats_the_majority_class(spark):
    rows = {r["row"]: r for r in subwords.train_eval_weighted(spark, "/root/testdata/sf0.01").collect()}
    support = [rows[k].support for k in rows if k in ("0", "1")]
    share = max(support) / sum(support)
    assert rows["macro avg"].f1_score > share / (1 + share) + 0.1  # what answering the larger class always gives
