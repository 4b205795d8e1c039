import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import jaccard


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b, t=0.8):
    x, y = shingles(a), shingles(b)
    return (a or "") == (b or "") or bool(x and y and len(x & y) >= t * len(x | y))


def brute(rows):
    """(class id, copies, links) by row, from all pairs."""
    n = len(rows)
    link = [[j for j in range(n) if j != i and alike(rows[i][1], rows[j][1])] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        new = [min([group[i]] + [group[j] for j in link[i]]) for i in range(n)]
        if new == group:
            break
        group = new
    ids = {}
    for g, (i, _) in zip(group, rows, strict=True):
        ids.setdefault(g, []).append(i)
    out = []
    for k, (i, t) in enumerate(rows):
        known = [x for x in ids[group[k]] if x is not None]
        out.append((i, t or "", min(known) if known else None, sum((u or "") == (t or "") for _, u in rows), len(link[k])))
    return out


def corpus(seed=7, families=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(20)]
    rng.shuffle(texts)
    return [(i * 2, t) for i, t in enumerate(texts)]


def joined(spark, rows, **options):
    got = jaccard.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, digest string"), **options).collect()
    text = {}
    for i, t in rows:
        text.setdefault((i, t or ""), 0)
    return got


@pytest.mark.parametrize("block", [3, 512])
def test_against_all_pairs(spark, block):
    rows = corpus() + [(1, ""), (3, None), (5, "!!! ???"), (7, "!!! ???"), (9, "A, b"), (11, "a b"), (None, "a b"), (13, "one two three four five"), (15, "One two, three four FIVE.")]
    got = joined(spark, rows, block=block)
    assert len(got) == len(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in got), key=key) == sorted(((i, c, n, m) for i, _, c, n, m in brute(rows)), key=key)


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for i in range(150):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, "something else entirely")]
    got = {r["doc_id"]: r for r in joined(spark, rows, block=16)}
    assert all(r["class_id"] == (0 if i < 2000 else 2000) for i, r in got.items())
    want = {i: n for i, *_, n in brute(rows)}
    assert {i: r["n_links"] for i, r in got.items()} == want


def test_floor_keeps_the_recall():
    floors = [jaccard.floor_of(r, 0.8, 24, 8) for r in (0.9, 0.99, 0.999, 0.99999)]
    assert floors == sorted(floors, reverse=True) and floors[0] == 8
    assert 1 - (1 - 0.8 ** floors[2]) ** 24 >= 0.999
    s = jaccard.least_found(0.999, 24, 8)
    assert 1 - (1 - s**8) ** 24 == pytest.approx(0.999)


def signed_classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return jaccard.signed(df, "doc_id", "text", 24, 8).withColumn("cls", F.col("id"))


def test_tries_hold_the_paths_that_share_a_prefix(spark):
    rows = corpus()
    classes = signed_classes(spark, rows)
    sig = {r["cls"]: np.frombuffer(r["signature"], np.uint16).reshape(24, 8) for r in classes.collect() if r["signature"]}
    got = {}
    for r in jaccard.trie_nodes(classes, 24, 8, 6).collect():
        for d in (6, 7, 8):
            got.setdefault((d, r[f"node_{d}"]), set()).add(r["cls"])
    want = {}
    for c, s in sig.items():
        for t in range(24):
            for d in (6, 7, 8):
                want.setdefault((d, t, s[t, :d].tobytes()), set()).add(c)
    alone = {(t, c) for (d, t, _), m in want.items() if d == 6 and len(m) == 1 for c in m}
    inner = [m for (d, t, _), m in want.items() if not any((t, c) in alone for c in m)]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, inner))


def test_descent_connects_what_all_pairs_of_nodes_would(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(250)]
    crowd = []
    for i in range(60):
        t = list(base)
        t[rng.randrange(250)] = f"x{i}"
        crowd.append(t)
    for _ in range(6):  # at some distance from the crowd
        t = list(base)
        for _ in range(5):
            t[rng.randrange(250)] = "far"
        crowd.append(t)
    rows = corpus() + [(5000 + i, " ".join(t)) for i, t in enumerate(crowd)]
    classes = signed_classes(spark, rows).where("signature IS NOT NULL")
    sig = {r["cls"]: np.frombuffer(r["signature"], np.uint16).reshape(24, 8) for r in classes.collect()}
    least = 0.8 - 5 * (0.8 * 0.2 / 192) ** 0.5
    shares = lambda a, b: (sig[a][:, :6] == sig[b][:, :6]).all(1).any() and (sig[a] == sig[b]).mean() >= least
    want = nx_components(list(sig), [(a, b) for a in sig for b in sig if a < b and shares(a, b)])
    for block in (4, 512):
        edges = jaccard.candidate_edges(classes, 24, 8, 6, 0.8, 0.999, block).collect()
        got = nx_components(list(sig), [(e["u"], e["v"]) for e in edges])
        assert got == want


def nx_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_classes_with_near_partners_stop_early(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, f"{base} x{i}") for i in range(30)] + [(100 + i, " ".join(f"v{i}_{j}" for j in range(50))) for i in range(5)]
    names = []
    keep = jaccard.written

    def seen(df, name):
        out = keep(df, name)
        names.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "written", seen)
    jaccard.candidate_edges(signed_classes(spark, rows), 24, 8, 6, 0.8, 0.999, 512)
    found = dict(names)
    assert found["near-stopped-8"] == 30 and found["near-pairs-7"] == found["near-pairs-6"] == 0
    assert 29 <= found["near-pairs-8"] <= 24 * 29  # one comparison joins a member of a node


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.r_[a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]
    s = jaccard.signatures([a, b], 1000)
    assert (s[0] == s[1]).mean() == pytest.approx(0.8, abs=0.06)


@pytest.mark.parametrize("n", [1, 30])
def test_components(spark, n):
    rng = random.Random(n)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(n)] + [(100 + i, 101 + i) for i in range(25)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for u, v in pairs:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for u, v in pairs if u != v for x in (u, v)}
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == want


def test_components_that_have_not_settled(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(25)], "u long, v long")
    with pytest.raises(RuntimeError, match="not settled"):
        jaccard.components(path, rounds=2)


def test_one_of_each(spark):
    rows = corpus() + [(None, "lonely null"), (None, "lonely null"), (0, corpus()[0][1]), (4, corpus()[0][1])]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, near_keep int")
    got = jaccard.one_of_each(df)
    groups = {(c if c is not None else t) for _, t, c, *_ in brute(rows)}
    kept = got.collect()
    assert got.columns == df.columns and len(kept) == len(groups)
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == {c for _, _, c, *_ in brute(rows) if c is not None}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).count() == 0 and jaccard.one_of_each(df).count() == 0
