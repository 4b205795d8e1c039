import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from loomgraph.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, most=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        often = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted(t for t, n in often.items() if n >= least)
        groups = sorted({s for _, s, _ in mine}, key=str.encode)
        count = {s: Counter(t for _, x, ts in mine if x == s for t in ts if often[t] >= least) for s in groups}
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))

        def listed(source, part, items, keep):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out.extend((lang, source, part, item, value, i) for i, (item, value) in enumerate(items, 1) if i <= keep)

        for a in groups:
            listed(a, "pair", [(b, sum((p(count[a], t) - p(count[b], t)) ** 2 // p(count[b], t) for t in kept)) for b in groups if b != a], 10**9)
            listed(a, "term", [(t, (p(count[a], t) - p(whole, t)) ** 2 // p(whole, t)) for t in kept if count[a][t] and p(count[a], t) > p(whole, t)], most)
    return sorted(out)


def made(seed, n=120, sources=("a", "b", "c", "Ä", None)):
    rng = np.random.default_rng(seed)
    vocab = ["The", "THE", "the", "für", "ÉTÉ", "été", "naïve", "x1y", "don't", "日本", "a_b", "Z", "tail\nline"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    for i in range(n):
        words = [vocab[int(j)] for j in np.minimum(rng.zipf(1.4, int(rng.integers(0, 40))), len(vocab)) - 1]
        yield (["en", "de", None][int(rng.integers(3))], sources[int(rng.integers(len(sources)))], " ".join(words))


EDGES = [(None, None, None), ("fr", "a", "un deux"), ("fr", "b", ""), ("fr", None, "deux 1 2 3"), ("it", "only", "x x x"), ("it", "only", "x"), ("it", "only", "x y")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "t", 1, None) for r in rows], "lang string, source string, text string, term string, n long, vec string")
    return sorted(tuple(r) for r in divergence.audit(df, **kw).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = list(made(seed)) + EDGES + [("en", "a", "same words again")] * 40
    assert run(spark, rows) == brute(rows)


def test_small_blocks_tiles_flushes_and_limits(spark, monkeypatch):
    rows = list(made(3, 80, sources=tuple("abcdefg")))
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence, "TILE", 3)
    assert run(spark, rows, cells=16, most_terms=2) == brute(rows, most=2)


def test_empty_and_without_kept_terms(spark):
    assert run(spark, []) == []
    rows = [("en", "a", "one"), ("en", "b", "two"), ("de", "x", None)]
    assert run(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_long_texts_are_counted_in_pieces():
    text = ("Wort für\x00wort " * 50).encode()
    assert [w for part in divergence.words(text, 7) for w in part] == [w.encode() for w in ["wort", "für", "wort"] * 50]


def test_long_division_is_exact():
    rng = np.random.default_rng(4)
    total = rng.integers(1, 9 * 10**15, 2000)
    count = (total * rng.random(2000)).astype(np.int64)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total, strict=True)]


def test_share_of_large_counts(spark):
    pairs = [(0, 1), (9_999_999_999_999, 10_000_000_000_000), (123, 9_007_199_254_740_993)]
    df = spark.createDataFrame(pairs, "c long, t long")
    assert [r[0] for r in df.select(divergence.share(df.c, df.t)).collect()] == [1 + 10**9 * (c + 1) // t for c, t in pairs]
