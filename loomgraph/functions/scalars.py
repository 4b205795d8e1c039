"""Scalar expressions that operators share; all are JVM-side but for the typo ratio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns, which differ by purpose and must stay distinct.
ID_START = r"^[A-Z]+-\w"
ID_ANYWHERE = r"[A-Za-z]+-\w+"
ID_UPPER = r"[A-Z]+-\w+"
ID_REGISTRY = r"^[A-Z]{2,6}-[A-Za-z0-9]+$"
EVIDENCE = r"\.py:\d+|:\d+"
# Words that stand for "no value".
NULL_WORDS = ("not found", "none", "n/a", "na", "null", "unknown", "-", "—", "unspecified")
# Confidence by tier of evidence.
TIERS = {"L1": 1.00, "L2": 0.90, "L3": 0.80, "L4": 0.62, "L5": 0.34}


def canonical_key(cls: Column, pk: Column) -> Column:
    """CID- and the first 16 hex digits of the SHA-1 of class::pk."""
    return F.concat(F.lit("CID-"), F.substring(F.sha1(F.concat(cls, F.lit("::"), pk).cast("binary")), 1, 16))


def relation_slug(header: str) -> str:
    """A relation's name from a column header."""
    import re

    out = re.sub(r"[^a-z0-9]+", "_", re.sub(r"\(FK\)|\(s\)", "", header, flags=re.I).lower()).strip("_")
    return out or "references"


def upper_slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(value), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")


def id_prefix(pk: Column) -> Column:
    return F.split_part(pk, F.lit("-"), F.lit(1))


def number(value: Column) -> Column:
    """The value as a double, or null."""
    return value.cast("string").try_cast("double")


def is_number(value: Column) -> Column:
    return number(value).isNotNull()


def is_null_word(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*NULL_WORDS)


def has_evidence(value: Column) -> Column:
    return F.coalesce(value.rlike(EVIDENCE), F.lit(False))


def singular(word: str) -> str:
    w = word.lower()
    if w.endswith("ies"):
        return w[:-3] + "y"
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def typo_possible(column: Column, token: str) -> Column:
    """Whether the lengths of a text, or of one of its words, allow a similarity of 0.8 to a token."""
    possible = lambda n: 2.0 * F.least(n, F.lit(len(token))) / (n + len(token)) >= 0.8
    return possible(F.length(column)) | F.exists(F.split(column, r"(?U)\s+"), lambda w: possible(F.length(w)))


def typo_ratio(token: str):
    """A function of two columns: the largest Ratcliff-Obershelp similarity of the token to one of the texts or to one of
    their words of three or more letters, in Arrow batches; of texts whose lengths don't rule out 0.8."""
    low = token.lower()

    @F.pandas_udf("double")
    def ratio(names: pd.Series, keys: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def fits(n: int) -> bool:
            return 2.0 * min(n, len(low)) / (n + len(low)) >= 0.8

        def best(*texts: str | None) -> float:
            words = [x.lower() for t in texts if t is not None for x in [t, *(w for w in t.split() if len(w) >= 3)] if fits(len(x))]
            return max((SequenceMatcher(None, low, x).ratio() for x in words), default=0.0)

        return pd.Series([best(a, b) for a, b in zip(names, keys, strict=True)], dtype="float64")

    return ratio.asNondeterministic()  # so that a filter on it is not pushed below, where it would run again
