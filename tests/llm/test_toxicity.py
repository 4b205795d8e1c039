import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lor", "min", "tas")]
    rude = ["scoundrel", "vermin", "stemnoxa", "stemnoxi", "stemnoxu"]
    docs, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        junk = not toxic and rng.random() < 0.2
        for _ in range(3 if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(rude) if rng.random() < 0.5 else "stemnox" + rng.choice("aeiou") * rng.randint(1, 3))
        docs.append((i, " ".join(["buynow"] * 6 + t if junk else t)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, 0.5, "x") for d in docs], "doc_id long, text string, p_toxic double, label_id string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, spark.createDataFrame(labels[:600], LABELS)).collect()}
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels[600:]}
    hits = sum(got[i]["rejected"] == bool(t) for i, t in truth.items())
    assert hits / len(truth) > 0.97
    junk = {i: 1 - q for i, q, _ in labels[600:]}
    assert np.mean([(got[i]["p_junk"] > 0.5) == bool(j) for i, j in junk.items()]) > 0.97


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(1)
    first = rng.integers(0, 2, 600)
    second = first ^ 1
    rows = [np.array([1000 + f, 2000 + int(rng.integers(0, 5))], np.int32) for f in first]
    chain = toxicity.train(rows, np.column_stack([first, second]), ["a", "b"])
    assert chain.models[1].weights.shape[0] == len(chain.kept) + 1 and chain.models[1].weights[-1] < 0
    p = chain.probabilities(toxicity.Bag([np.array([chain.kept[1001]])]))[0]
    assert p[0] > 0.8 and p[1] < 0.2


def dense_chain(x, ys, most, folds=3):
    """The chain in plain loops over a dense 0/1 matrix of all features: thresholds and a function for probabilities."""

    def chosen(x, ys):
        score = {}
        for j in range(x.shape[1]):
            for c in range(ys.shape[1]):
                known = ys[:, c] >= 0
                f, y = x[known, j], ys[known, c]
                if len(set(y)) < 2 or f.sum() < 4:
                    continue
                a, b = (f * y).sum(), (f * (1 - y)).sum()
                n, p = len(y), y.sum()
                chi = (a * (n - p - b) - b * (p - a)) ** 2 * n / max(1, (a + b) * (n - a - b) * p * (n - p))
                score[j] = max(score.get(j, 0), chi)
        return sorted((j for j in score if score[j] > 10.83), key=lambda j: (-score[j], j))[:most]

    def fitted(z, y, plain):
        if not len(y) or len(set(y)) < 2:
            return np.zeros(z.shape[1]), (0.0 if not len(y) else 4.0 if y[0] else -4.0)
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        w, m, v = np.zeros(z.shape[1] + 1), 0.0, 0.0
        for step in range(1, 151):
            g = weight * (1 / (1 + np.exp(-(z @ w[:-1] + w[-1]))) - y)
            grad = np.append(z.T @ g + w[:-1], g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - (1 - step / 151) / np.sqrt(max(1.0, plain)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return w[:-1], w[-1]

    def model(x, ys, earlier, c, cols, rows):
        rows = rows[ys[rows, c] >= 0]
        return fitted(np.column_stack([x[np.ix_(rows, cols)], earlier[rows, :c]]), ys[rows, c], x[np.ix_(rows, cols)].sum(1).mean())

    def apply(m, x, earlier):
        return 1 / (1 + np.exp(-(np.column_stack([x, earlier]) @ m[0] + m[1])))

    n, earlier = len(x), np.zeros(ys.shape)
    for c in range(ys.shape[1]):
        for f in range(folds):
            use, out = np.flatnonzero(np.arange(n) % folds != f), np.flatnonzero(np.arange(n) % folds == f)
            cols = chosen(x[use], ys[use])
            earlier[out, c] = apply(model(x, ys, earlier, c, cols, use), x[np.ix_(out, cols)], earlier[out, :c])
    cols = chosen(x, ys)
    models = [model(x, ys, earlier, c, cols, np.arange(n)) for c in range(ys.shape[1])]

    def probabilities(new):
        out = np.zeros((len(new), 0))
        for m in models:
            out = np.column_stack([out, apply(m, new[:, cols], out)])
        return out

    return earlier, probabilities


def test_chain_against_dense_loops():
    rng = np.random.default_rng(8)
    n, width = 240, 60
    x = (rng.random((n, width)) < 0.15).astype(float)
    first = (x[:, :3].sum(1) + rng.random(n) > 1.2).astype(int)
    second = ((x[:, 3:6].sum(1) + first * 0.6 + rng.random(n)) > 1.4).astype(int)
    ys = np.column_stack([first, second])
    ys[rng.random(ys.shape) < 0.1] = -1
    rows = [np.flatnonzero(r).astype(np.int32) for r in x]
    chain = toxicity.train(rows, ys, ["a", "b"], most_features=8)
    earlier, probabilities = dense_chain(x, ys, 8)
    new = (rng.random((50, width)) < 0.15).astype(float)
    got = chain.probabilities(toxicity.Bag([np.array([chain.kept[j] for j in np.flatnonzero(r) if j in chain.kept], int) for r in new]))
    assert np.allclose(got, probabilities(new), atol=1e-6)
    for c in (0, 1):
        known = ys[:, c] >= 0
        assert chain.thresholds[c] == pytest.approx(toxicity.best_threshold(earlier[known, c], ys[known, c]), abs=1e-6)


def test_features_are_chosen_within_folds(monkeypatch):
    seen, keep = [], toxicity.select_features
    monkeypatch.setattr(toxicity, "select_features", lambda rows, ys, most: seen.append(len(rows)) or keep(rows, ys, most))
    toxicity.train([np.array([i % 7], np.int32) for i in range(90)], np.arange(90)[:, None] % 2, ["a"])
    assert seen == [60, 60, 60, 90]


def test_rows_that_share_an_id_train_on_the_first_text(spark):
    docs = [(1, "zeta"), (1, "alpha"), (1, None), (2, "b"), (2, "a")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS)
    got = [toxicity.sample_features(spark.createDataFrame(d, "doc_id long, text string"), labels, toxicity.label_categories(), "doc_id", "text", 10) for d in (docs, docs[::-1])]
    want = {tuple(sorted(toxicity.parts("a"))), ()}
    for rows, ys in got:
        assert {tuple(r) for r in rows} == want and ys.tolist() == got[0][1].tolist()


def test_missing_labels_are_left_out():
    rows = [np.array([5 if i % 2 else 6], np.int32) for i in range(60)]
    ys = np.array([[i % 2, -1] if i < 30 else [-1, i % 2] for i in range(60)])
    chain = toxicity.train(rows, ys, ["a", "b"])
    p = chain.probabilities(toxicity.Bag([np.array([chain.kept[x]]) for x in (5, 6)]))
    assert p[0, 1] > 0.6 > p[1, 1]


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(None, 0, 1), (99999, 0, 1)], [(0, None, None)]])
def test_nothing_to_learn(spark, labels):
    docs = spark.createDataFrame([(0, "a b"), (1, None), (None, ""), (1, None)], "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 4 and not any(r["rejected"] for r in got)
    assert toxicity.accepted(docs, spark.createDataFrame(labels, LABELS)).count() == 4


def test_accepted_keeps_columns_and_odd_rows(spark):
    docs, labels = corpus(400)
    rows = [(*d, i) for i, d in enumerate(docs)] + [(None, None, -1), (5000, "", -2), (5001, "stemnoxa vermin scoundrel " + "bamin " * 50_000, -3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p_junk int")
    kept = toxicity.accepted(df, spark.createDataFrame(labels, LABELS))
    ids = {r["p_junk"] for r in kept.select("p_junk").collect()}
    assert kept.columns == df.columns and {-1, -2} <= ids and -3 not in ids
    assert kept.where(F.col("text").contains("stemnox")).count() <= 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.toxicity(df, spark.createDataFrame([], LABELS)).count() == 0


def test_features_stay_with_the_executors(spark, monkeypatch):
    docs, labels = corpus(300)
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    want = toxicity.train(*toxicity.sample_features(df, known, toxicity.label_categories(), "doc_id", "text", 200), ["junk", "toxic"])
    monkeypatch.setattr(type(df), "toArrow", lambda self: pytest.fail("features came to the driver"))
    got = toxicity.train_chain(df, known, toxicity.label_categories(), sample=200)
    assert got.kept == want.kept and got.kept and np.allclose(got.thresholds, want.thresholds)
    assert all(np.allclose(a.weights, b.weights) for a, b in zip(got.models, want.models, strict=True))
    none = toxicity.train_chain(df, known.limit(0), toxicity.label_categories())
    assert none.kept == {} and len(none.models) == 2


def test_features_are_selected_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 1 << toxicity.BITS, 50)).astype(np.int32) for _ in range(40)]
    rows = [np.append(r, [7] if i % 2 else [9]).astype(np.int32) for i, r in enumerate(rows)]
    tracemalloc.start()
    kept = toxicity.select_features(rows, np.arange(40)[:, None] % 2, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(kept) == {7, 9} and peak < 60e6
