import numpy as np
import pytest

from loomgraph.llm import ann


def brute(rows, every=20, k=20):
    ok = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault(i, v)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids], float)
    out = {}
    for q in ids[ids % every == 0]:
        s = x @ np.array(ok[q], float)
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def clustered(n, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    x = centres[rng.integers(0, 12, n)] + 0.5 * rng.standard_normal((n, d))
    return [(i, [float(a) for a in r]) for i, r in enumerate(x.astype(np.float32))]


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_exact_mode(spark):
    rows = clustered(300) + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] + [1.0] * 15), (None, [1.0] * 16), (1080, []), (1100, [1.0, 2.0])]
    rows += [(2000 + i, rows[20][1]) for i in range(45)]  # copies of a vector, some of them queries
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, part int")
    got, want = collected(ann.nearest(df, exact=True)), brute([r for r in rows if r[0] != 1100])
    assert set(got) == set(want)
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], rtol=1e-12)


@pytest.mark.parametrize("n", [300, 6000])
def test_recall_of_routed_search(spark, n):
    rows = clustered(n)
    got, want = collected(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), sample=3000, bin_rows=50)), brute(rows)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert set(got) == set(want) and recall >= 0.9 and all(len(x) == 20 for x in got.values())


@pytest.mark.parametrize("n", [400, 3000])
def test_routing_looks_at_few_parts(n):
    x = np.array([v for _, v in clustered(n)])
    r = ann.fit(x, ann.parts_for(n))
    sizes = np.bincount(r.home(x), minlength=ann.parts_for(n))
    looked = np.mean([sizes[p].sum() / n for p in r.routes(x[::20], sizes, 21)])
    assert looked < 0.5 and sizes.max() < 6 * n / len(sizes)


def test_routes_hold_enough_rows():
    x = np.array([v for _, v in clustered(200)])
    r = ann.fit(x, 14)
    sizes = np.bincount(r.home(x), minlength=14)
    r.mass = 0.0
    assert all(sizes[p].sum() >= 21 for p in r.routes(x, sizes, 21))


def test_parts_grow_with_the_table():
    got = [ann.parts_for(n) for n in (1, 9, 500, 2_000, 51_282, 1_000_000, 10**9)]
    assert got == [1, 2, 22, 45, 226, 1000, 4096]


def test_blocks_follow_the_routed_queries(spark):
    rows = clustered(2000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    a, b = (collected(ann.nearest(df, every=1, bin_rows=r)) for r in (300, 8192))
    assert a == b  # several blocks a bin


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(20, [1.0, 0.0])], schema)).count() == 0
    got = collected(ann.nearest(spark.createDataFrame([(20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [0.5, 0.0]), (20, [1.0, 0.0])], schema)))
    assert [i for i, _ in got[20]] == [21, 22]


def test_bins():
    sizes = {0: 40, 1: 70, 2: 350, 3: 10, 5: 80, 6: 20}
    got = ann.bins_of(sizes, 100)
    assert set(got) == set(sizes) and got[2][1] - got[2][0] == 4 and got[5] == got[3] and got[6] != got[5]
    load = {}
    for p, (lo, hi) in got.items():
        for b in range(lo, hi):
            load[b] = load.get(b, 0) + sizes[p] / (hi - lo)
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))


def test_a_huge_vector_does_not_hide_the_others(spark):
    rows = clustered(300)
    x = np.array([v for _, v in rows])
    router = ann.fit(x, 17)
    huge = np.vstack([x, np.full((1, x.shape[1]), 1e200)])
    got = ann.fit(huge, 17)
    assert len(np.unique(got.home(x))) >= 0.6 * len(np.unique(router.home(x))) and np.isfinite(got.logits(huge)).all() and got.mass > 1e-6
    df = spark.createDataFrame([*rows, (9001, huge[-1].tolist()), (9020, [-1e200, 1e200] + [0.0] * (x.shape[1] - 2))], "vec_id long, embedding array<double>")
    found = collected(ann.nearest(df))
    assert all(len(v) == 20 for v in found.values()) and found[9020][0][1] < np.inf


def test_products_beyond_doubles():
    a, b = np.array([[1e200, 1e200]]), np.array([[1e200, -1e200], [1e200, 1e200], [-1e200, -1e200], [1.0, 1.0]])
    assert ann.products(a, b).tolist() == [[-np.inf, np.inf, -np.inf, 2e200]]
    assert ann.exact_scores(np.repeat(a, 4, 0), b).tolist() == [-np.inf, np.inf, -np.inf, 2e200]
