import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import sketch


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def texts(n=40, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(0, 900))) for _ in range(n)]


def brute(rows):
    signed = lambda t: (h := xxhash.xxh64_intdigest(t, seed=42)) - (h >> 63 << 64)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1] or ""), r[1] or ""))
    out = []
    for i, (id_, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        out.append((id_, t, t[: len(t) - q] + nxt[:q], nxt))
    return out


def test_against_exact(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts())] + [(1, ""), (2, None), (None, "null id here"), (500, "one two"), (501, "one two"), (502, "日本 " * 30)]
    random.Random(2).shuffle(rows)
    got = {r["doc_id"]: r for r in sketch.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    import hashlib

    for id_, t, edited, nxt in brute(rows):
        r = got[id_]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(t, edited), abs=0.17)
        assert r["near_next"] == pytest.approx(jaccard(t, nxt), abs=0.17)
        assert r["n_shingles"] == pytest.approx(len(shingles(t)), rel=0.35)
    assert got[500]["fingerprint"] == got[501]["fingerprint"] and got[1]["fingerprint"] == got[2]["fingerprint"]


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_ranges_give_the_same_next(spark, rows):
    data = [(i // 2, f"t{i}") for i in range(50)] + [(None, "n1"), (None, "n2"), (7, "t14")]
    got = sketch.with_next(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text", {}, rows).collect()
    want = sorted((id_ is None, id_ or 0, t, n) for id_, t, _, n in brute(data))
    assert sorted((r["id"] is None, r["id"] or 0, r["text"], r["next_text"]) for r in got) == want


def test_many_rows_without_an_id_or_with_one(spark, monkeypatch):
    """Ranges of one id are cut by the hash; no window has many more rows than a range is to have."""
    data = [(None, f"n{i}") for i in range(300)] + [(5, f"t{i}") for i in range(300)] + [(i, f"s{i}") for i in range(40)] + [(None, "n7")] * 3
    sizes, keep = [], sketch.small
    monkeypatch.setattr(sketch, "small", lambda df, rows, most=100_000: sizes.append((df.columns, rows)) or keep(df, rows, most))
    got = sketch.with_next(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text", {}, 20).collect()
    want = sorted((id_ is None, id_ or 0, t, n) for id_, t, _, n in brute(data))
    assert sorted((r["id"] is None, r["id"] or 0, r["text"], r["next_text"]) for r in got) == want
    assert sizes[0][1] >= 2 and sizes[1][1] >= 2 * 300 // 20 * 0.8


def test_merge_containment_and_counts(spark):
    a, b = texts(2, 5)[0] * 3, texts(2, 6)[1] * 2
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string").select(*(sketch.sketch(F.col(c)).alias(c) for c in ("a", "b", "ab")))
    r = df.select(sketch.resemblance(sketch.merged(F.col("a"), F.col("b")), F.col("ab")), sketch.containment(F.col("a"), F.col("ab")), sketch.distinct_shingles(F.col("ab"))).first()
    assert r[0] > 0.9 and r[1] > 0.8 and r[2] == pytest.approx(len(shingles(a + " " + b)), rel=0.3)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sketch.document_fingerprints(empty).count() == 0
    one = sketch.document_fingerprints(spark.createDataFrame([(1, "abcd efgh", "x", 3)], "doc_id long, text string, a string, id int")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_no_python_in_the_plan(spark):
    df = sketch.document_fingerprints(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_many_ranges(spark):
    bounds = [3 * i - 700 for i in range(1200)]
    ids = [-10_000, -700, -699, 0, 1, 2, 68, 69, 1000, 2897, 2898, 99_999, None]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", sketch._range_of(bounds, F.col("id")).alias("n")).collect()
    assert {r["id"]: r["n"] for r in got} == {i: len(bounds) + 1 if i is None else sum(b <= i for b in bounds) for i in ids}
