import random
import re

import numpy as np
import pytest

from loomgraph.llm import mixing

ENGLISH = [("a b c", 3), ("  ", 0), ("", 0), (None, 0), ("x y z", 2), ("a\x1fb c\x0bd", 3), ("é\n\nü", 2)]


def test_words(spark):
    df = spark.createDataFrame([(t, n) for t, n in ENGLISH], "t string, n int").select(mixing.words("t").alias("got"), "n")
    assert all(r["got"] == r["n"] for r in df.collect())


def brute_targets(sizes, weights):
    free, total, out = set(range(len(sizes))), sum(sizes), [0.0] * len(sizes)
    for _ in range(len(sizes) + 1):
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        for i in free:
            out[i] = left * weights[i] / sum(weights[j] for j in free)
        over = {i for i in free if out[i] > 3 * sizes[i] + 1e-9}
        if not over:
            return out
        for i in over:
            out[i] = 3.0 * sizes[i]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 1000], [5], [0, 10, 10], [1, 1, 5000, 3], [0, 0]])
def test_targets(sizes):
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes, w) == pytest.approx(brute_targets(sizes, w))


def test_resolve_keeps_words_and_expectations():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 50, 40).astype(float)
    p = np.full(40, 0.37)
    total = np.zeros(40)
    for _ in range(3000):
        out, held = mixing.resolve(size, p, rng.random(40))
        assert ((out == 0) | (out == 1)).sum() >= 39
        assert out @ size == pytest.approx(p @ size)
        if held >= 0:
            out[held] = rng.random() < out[held]
        total += out
    assert np.abs(total / 3000 - 0.37).max() < 0.05


def corpus(n=600):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 80))), rng.choice(["s1"] * 6 + ["s2", "s3", None])) for i in range(n)]
    return rows + [(7, "same text here", "s1")] * 3 + [(None, "null id text", "s2"), (9000, None, "s3"), (9001, "", None)]


@pytest.mark.parametrize("fan_in", [7, 20_000])
def test_mix(spark, fan_in):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.mix_report(df, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(df.repartition(3), fan_in=fan_in).collect()))
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    taken, by_size = {}, {size[s]: s for s in order}
    for r in got:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(want[s]) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 80 for s in order)


def test_documents_of_the_mix(spark):
    rows = corpus(200)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, mix_key int")
    want = sum(r["copies"] for r in mixing.mix_report(df).collect())
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and got.count() == want and {r["mix_key"] for r in got.collect()} <= set(range(len(rows)))


def test_groups_stay_below_the_fan_in(spark):
    rows = spark.range(60_000).selectExpr("id", "id * 7 AS h", "1 AS nth", "cast(id % 100 = 0 AS int) AS source_no")
    table, largest = mixing.dealt(rows, 1_000, 1, 0)
    sizes = {(r["source_no"], r["bucket"]): r["count"] for r in table.groupBy("source_no", "bucket").count().collect()}
    assert largest == 59_400 and max(sizes.values()) <= 1_000 and sizes[1, 0] == 600


@pytest.mark.parametrize("rows, rate", [([(i, "w " * (1 + i % 9), "only") for i in range(500)], 1), ([(i, "w " * 9, "a" if i % 50 else "b") for i in range(500)], None)])
def test_whole_rates_need_no_rounding(spark, monkeypatch, rows, rate):
    """One source (rate 1), and a source capped at three times its size: their rows are in no bucket."""
    seen = []
    monkeypatch.setattr(mixing, "written", lambda df, name, keep=mixing.written: seen.append(out := keep(df, name)) or out)
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string"), fan_in=100).collect()
    rounded_sources = {r["source_no"] for df in seen[1:] for r in df.select("source_no").distinct().collect()}
    assert rounded_sources == (set() if rate else {0})
    small_ = [r for r in got if rate or r["source_size"] == 90]
    assert {r["copies"] for r in small_} == {rate or 3} and len(got) == 500


def test_ids_of_any_text(spark):
    ids = ["null", None, "a|b", "a", "", '"', "null"]
    df = spark.createDataFrame([(x, "one two three", "s") for x in ids], "doc_id string, text string, source string")
    assert sorted(str(r["doc_id"]) for r in mixing.mix_report(df).collect()) == sorted(map(str, ids))
    assert sorted(str(r["doc_id"]) for r in mixing.mixed_documents(df).collect()) == sorted(map(str, ids))


def test_empty(spark):
    assert mixing.mix_report(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([(1, "", "a")], "doc_id long, text string, source string")).count() == 0
