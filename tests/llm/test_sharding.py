import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import sharding


def test_matrix_margins_and_means():
    counts = np.array([50, 0, 131, 7, 320])
    total = np.zeros((5, 4))
    for seed in range(400):
        m = sharding.communication_matrix(counts, 4, seed)
        assert (m.sum(1) == counts).all() and set(m.sum(0)) <= {127} and m.min() >= 0 if counts.sum() % 4 == 0 else m.sum(0).max() - m.sum(0).min() <= 1
        total += m
    assert np.abs(total / 400 - counts[:, None] / 4).max() < 1.5


def test_large_draws_are_hypergeometric():
    rng = np.random.default_rng(5)
    got = np.array([sharding.hypergeometric(rng, 2 * 10**9, 6 * 10**9, 1000) for _ in range(4000)])
    assert abs(got.mean() - 250) < 1.0 and abs(got.var() - 187.5) < 15
    assert sharding.hypergeometric(rng, 0, 2 * 10**9, 10) == 0 and sharding.hypergeometric(rng, 2 * 10**9, 0, 10) == 10


ROWS = [(i, f"text {i % 30}") for i in range(1000)] + [(3, "text 3")] * 5 + [(None, None), (None, "ü" * 10), (5000, "")]


@pytest.mark.parametrize("rows_per_part", [16, 1 << 17])
def test_shards(spark, rows_per_part):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], "doc_id long, text string, shard int, slot string, part int")
    got = sharding.sharded(df, rows_per_part=rows_per_part).collect()
    again = sharding.sharded(df.repartition(5), rows_per_part=rows_per_part).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_uniform(spark):
    got = sharding.sharded(spark.createDataFrame([(i, str(i)) for i in range(4000)], "doc_id long, text string"), shards=4).collect()
    # neighbours by id land in the same shard by chance only, and places don't follow ids
    shard = {r["doc_id"]: r["shard"] for r in got}
    assert 0.2 < np.mean([shard[i] == shard[i + 1] for i in range(3999)]) < 0.3
    assert abs(np.corrcoef([r["doc_id"] for r in got], [r["slot"] for r in got])[0, 1]) < 0.06


def test_few_rows_and_none(spark):
    schema = "doc_id long, text string"
    assert sharding.sharded(spark.createDataFrame([], schema)).count() == 0
    assert sorted(r["slot"] for r in sharding.sharded(spark.createDataFrame([(1, "a"), (2, "b")], schema)).collect()) == [0, 0]


def test_draws_from_large_urns_follow_the_law():
    """Beyond numpy's range: mean and variance over many draws, and the same law as numpy's just below."""
    rng = np.random.default_rng(4)
    good, bad, n = 400_000_000_000, 600_000_000_000, 1_000
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)])
    assert abs(x.mean() - 400) < 4 * (240 / 4000) ** 0.5 and abs(x.var() / 240 - 1) < 0.1
    assert sharding.hypergeometric(rng, 10, 10**12, 10**12 + 10) == 10
    assert sharding.hypergeometric(rng, 10**12, 3, 0) == 0
