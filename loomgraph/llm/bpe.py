"""Byte-level BPE with a local rank file, by tiktoken.

A long text is cut into pieces before it is encoded, at positions that no match of the splitting pattern spans or looks
across, so that the pieces' ids are those of the whole text and the memory an encoder holds at once is bounded by the piece.
Which positions are safe depends on the pattern: ``boundary`` is a regular expression for them, and a pattern that comes
without one is applied to whole texts. BOUNDARY fits patterns whose alternatives are contractions, an optional blank and
letters, digits or other characters, and white space: safe are a blank or line feed after anything but white space, and changes
between ASCII letters, digits and punctuation but the apostrophe, or between ideographs or kana and their punctuation.
A run of one kind without any of these is one piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PIECE = 100_000
_encoders: dict[tuple[bytes, str], object] = {}
# Python's white space is wider, and so \S narrower, than in other engines; the other classes are the same in all
_mark = r"[!-&(-/:-@\[-`{-~]"
BOUNDARY = "|".join([r"(?<=\S)(?=[ \n])", "(?<=[A-Za-z])(?=[0-9])", "(?<=[0-9])(?=[A-Za-z])", f"(?<=[A-Za-z0-9])(?={_mark})", f"(?<={_mark})(?=[A-Za-z0-9])", "(?<=[ぁ-ヺ一-龥])(?=[、。！？])", "(?<=[、。！？])(?=[ぁ-ヺ一-龥])"])


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def encoder(data: bytes, pattern: str):
    """The encoder of a rank file's bytes; a Python worker builds it once."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _encoders:
        import tiktoken

        _encoders[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks_of(data), special_tokens={})
    return _encoders[key]


def pieces(text: str, boundary: re.Pattern | None, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` code points that end at safe boundaries; whole, without a boundary."""
    start = 0
    while boundary and len(text) - start > size and (m := boundary.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(enc, text: str, boundary: re.Pattern | None = None, size: int = PIECE) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in pieces(text, boundary, size):
        out += enc.encode_ordinary(piece)
    return out


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, boundary: str | None = None) -> DataFrame:
    """Encode each whole text (null: empty), decode the ids to raw bytes; one row a row, without an exchange.

    Returns id_col, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 and, on request, ids and
    decoded. Null ids stay null, repeated rows are encoded again. The rank file is read on the driver and broadcast; it
    has one row a token (some 100,000) whatever the input, and files of over 32 MB are refused.
    """
    spark: SparkSession = docs.sparkSession
    with open(rank_file, "rb") as f:
        data = f.read((32 << 20) + 1)
    if len(data) > 32 << 20:
        raise ValueError("the rank file has more than 32 MB")
    held = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc, cut = encoder(held.value, pattern), re.compile(boundary) if boundary else None
        for batch in batches:
            counts, ids_sha, decoded_sha, all_ids, all_bytes = [], [], [], [], []
            for x in batch.column(1):
                ids = encode(enc, x.as_py() or "", cut)
                raw = enc.decode_bytes(ids)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    all_bytes.append(raw)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_bytes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)
