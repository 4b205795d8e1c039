import hashlib
import random
import re

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENC = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(open(FILE, "rb").read()), special_tokens={})
TEXTS = ["", "Hello wörld", " \n\n a  b\t", "it's 12345 !!??", "<|endoftext|> plain", "naïve 日本語 🙂", "a" * 5000, "word " * 60_000, "\x1c\x1d! \x85x", None]


CUT = re.compile(bpe.BOUNDARY)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abS1'.!-^ \n\t\x1c\x85 é日、あ")), max_size=60), st.integers(1, 8))
def test_pieces_keep_ids(text, size):
    assert "".join(bpe.pieces(text, CUT, size)) == text
    assert bpe.encode(ENC, text, CUT, size) == ENC.encode_ordinary(text)


def test_long_texts_without_blanks_are_cut():
    rng = random.Random(2)
    text = "".join(rng.choice(["abc", "12", "--", "日本、", "x'll"]) for _ in range(200_000))
    got = list(bpe.pieces(text, CUT))
    assert max(map(len, got)) < bpe.PIECE + 50 and "".join(got) == text
    assert bpe.encode(ENC, text, CUT) == ENC.encode_ordinary(text)


def test_other_patterns_are_applied_to_whole_texts(spark):
    """Here punctuation takes the line feeds after it: a cut before a line feed would change the ids."""
    pattern = r" ?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+"
    text = "ab!\n" * 60_000
    whole = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.ranks_of(open(FILE, "rb").read()), special_tokens={}).encode_ordinary(text)
    got = bpe.bpe_round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), FILE, pattern, with_ids=True).first()
    assert got["ids"] == whole


def test_whole_texts(spark):
    rows = [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(None, "null id", 0, 0), (1, TEXTS[1], 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids int")
    got = bpe.bpe_round_trip(df, FILE, public_tokenizers.PATTERN, with_ids=True, boundary=bpe.BOUNDARY).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows:
        ids = ENC.encode_ordinary(t or "")
        r = by[i]
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and bytes(r["decoded"]) == (t or "").encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_round_trip(df, FILE, public_tokenizers.PATTERN).count() == 0
