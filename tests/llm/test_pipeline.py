import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        from loomgraph.llm.shared import written

        docs = written(f(spark, docs, SMALL), "stage-test")
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def built(spark):
    return stages(spark)


def test_stages_keep_columns(built):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "mixing", "tokens"]
    for df in built[1:-1]:
        assert df.schema.simpleString() == built[0].schema.simpleString()


def test_accepted_documents_stay_as_they_are(built):
    before = {r["doc_id"]: r for r in built[0].collect()}
    assert all(before[r["doc_id"]] == r for r in built[1].collect())


def test_toxic_documents_go(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{LARGER}/documents.parquet"), LARGER).join(labels, "doc_id")
    assert left.where("toxic = 1").count() <= 0.1 * labels.where("toxic = 1").count()
    assert left.where("toxic = 0").count() >= 0.97 * labels.where("toxic = 0").count()


def test_lines(built):
    from test_linededup import brute

    want = brute([(r["doc_id"], r["text"]) for r in built[1].collect()])
    assert {r["doc_id"]: r["text"] for r in built[2].collect()} == {i: t for i, (t, *_) in want.items()}


def test_near_duplicates(built):
    from test_jaccard import brute

    want = {c for _, _, c, *_ in brute([(r["doc_id"], r["text"]) for r in built[2].collect()])}
    assert {r["doc_id"] for r in built[3].collect()} == want and built[3].count() == len(want)


def test_mix(built):
    from loomgraph.llm import mixing

    want = {r["doc_id"]: r["copies"] for r in mixing.mix_report(built[3]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in built[4].collect()) == want


def test_tokens(built):
    import public_tokenizers
    import tiktoken

    from loomgraph.llm import bpe

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(open(public_tokenizers.path(queries.RANK_FILE), "rb").read()), special_tokens={})
    want = Counter((r["doc_id"], len(enc.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in built[4].collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in built[5].collect()) == want


def test_run_agrees_with_stages(built, spark):
    a = corpus_pipeline.run(spark, SMALL).agg(F.count("*"), F.sum("n_tokens")).first()
    assert a == built[5].agg(F.count("*"), F.sum("n_tokens")).first()


def test_odd_documents(spark, tmp_path):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", None, 0, "x"), (1, "", "en", None, 0, "x"), (2, "word " * 40_000, "en", "s", 200_000, "y"), (3, "a\nb\nc", "en", "s", 5, "z"), (4, "a\nb\nc", "en", "s", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mix_key string")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SMALL)
    assert {r["doc_id"] for r in docs.collect()} <= {1, 2, 3, 4, None}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SMALL)
    assert docs.count() == 0
