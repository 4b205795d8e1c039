import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import linededup, shared


def brute(rows):
    """Each text without later windows; rows in the order of ids."""
    seen, out = set(), {}
    for id_, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[id_] = (None, 0, 0)
            continue
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not "".join(w).strip():
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[id_] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def deduped(spark, rows):
    df, before, gone = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: (r["text"], r[before], r[gone]) for r in df.collect()}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    return [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", " ", "longer line"]) for _ in range(rng.randint(1, 12)))) for i in range(n)]


def test_against_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed) + [(100, None), (101, ""), (102, "x\ny"), (103, "\n\n\n\n"), (None, "q\nr\ns\nt"), (104, "q\nr\ns")]
        assert deduped(spark, rows) == brute(rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=8))
def test_any_lines(spark, texts):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    assert deduped(spark, rows) == brute(rows)


def test_repeated_rows_and_extra_columns(spark):
    rows = [(1, "a\nb\nc", 5, "u"), (1, "a\nb\nc", 6, "v"), (2, "a\nb\nc\nd", 7, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, line_hash string")
    out, before, gone = linededup.dedup_lines(df)
    assert out.columns[:4] == df.columns and before != "n_lines"
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["line_hash"], r[gone]) for r in out.collect()) == [(1, "", 6, "v", 3), (1, "a\nb\nc", 5, "u", 0), (2, "d", 7, "w", 3)]


def test_equal_texts_without_ids_keep_one_occurrence(spark):
    df = spark.createDataFrame([(None, "a\nb\nc")] * 5 + [(None, "b\nc")] * 2, "doc_id long, text string").repartition(3)
    df.write.mode("overwrite").parquet(path := shared.scratch(spark, "line-test"))
    out, _, gone = linededup.dedup_lines(spark.read.parquet(path))
    assert sorted((r["text"], r[gone]) for r in out.collect()) == [("", 3)] * 4 + [("a\nb\nc", 0)] + [("b\nc", 0)] * 2


def test_long_text_of_repeats(spark):
    rows = [(1, "\n".join(["x", "y", "z"] * 5000))]
    assert deduped(spark, rows) == brute(rows)


def test_empty_and_native(spark):
    df, *_ = linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert df.count() == 0
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    assert df.select(F.count("*")).first()[0] == 0
