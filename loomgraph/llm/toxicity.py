"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another, each by a logistic regression over the text's features and the
probabilities of the categories before it. For training, those earlier probabilities are out-of-fold predictions, so that
a later model sees them as it will on new texts. Categories are 0/1 columns of the label table; a category's missing
labels are left out of its training. Features are chosen within each fold as well, from the other folds' rows, so that no
out-of-fold prediction, and no threshold chosen by them, has seen its own label of that category.

Features are presences: words in lower case and their first 4, 5 and 6 letters (for stems), of whole texts. The model
keeps at most ``most_features`` of them, those whose presence differs most between a category's classes (chi square, at
least its 99.9 % point), found on a bounded sample of labelled rows (``sample``, by the hash of the id). Of rows with the same id the text that sorts
first is trained on, of repeated labels the largest. The sample's features meet in one task, which trains; the driver gets the
model alone. All documents are scored, by whole text, a batch at a time.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

SAMPLE, FEATURES, BITS, FOLDS = 10_000, 4_096, 21, 3
CHI_SQUARE = 10.83  # the 99.9 % point for one degree of freedom
_word = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[int]:
    """Hashes of a word's features, below 2^BITS."""
    import xxhash

    out = [word] + [f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n]
    return [xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in out]


class Features(dict):
    """Feature numbers by word, for words that come again; emptied when there are too many."""

    def __init__(self, kept: dict[int, int] | None = None):
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        p = parts(word)
        out = self[word] = tuple(p) if self.kept is None else tuple({self.kept[x] for x in p if x in self.kept})
        return out

    def of(self, text: str) -> set[int]:
        out: set[int] = set()
        for x in map(self.__getitem__, set(_word.findall(text.lower()))):
            if x:
                out.update(x)
        return out


class Bag:
    """The feature numbers of some texts, end to end."""

    def __init__(self, rows: Sequence[np.ndarray]):
        self.n = len(rows)
        self.flat = np.concatenate(rows).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights[self.flat], self.n)


@dataclass
class Linear:
    weights: np.ndarray  # of features, then of earlier categories
    bias: float

    def logits(self, bag: Bag, earlier: np.ndarray) -> np.ndarray:
        n = len(self.weights) - earlier.shape[1]
        return bag.sums(self.weights[:n]) + earlier @ self.weights[n:] + self.bias


@dataclass
class Chain:
    categories: list[str]
    kept: dict[int, int]
    models: list[Linear]
    thresholds: list[float]

    @property
    def plain(self) -> tuple:
        """What makes the chain again, without classes of this module, which tasks get by value."""
        return self.categories, self.kept, [(m.weights, m.bias) for m in self.models], self.thresholds

    def probabilities(self, bag: Bag) -> np.ndarray:
        """A row a text, a column a category."""
        out = np.zeros((bag.n, 0))
        for m in self.models:
            out = np.column_stack([out, sigmoid(m.logits(bag, out))])
        return out


def chain_of(plain: tuple) -> Chain:
    categories, kept, models, thresholds = plain
    return Chain(categories, kept, [Linear(*m) for m in models], thresholds)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_linear(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, n: int, l2: float = 1.0, steps: int = 150) -> Linear:
    """Logistic regression on presences and earlier probabilities by accelerated gradient descent."""
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(n + earlier.shape[1]), 0.0 if not len(y) else 4.0 if y[0] else -4.0)
    bag = Bag(rows)
    flat, of, mean_length = bag.flat, bag.of, len(bag.flat) / bag.n
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))  # the classes count alike
    scale = 1 / np.sqrt(max(1.0, mean_length))
    w, b = np.zeros(n + earlier.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = bag.sums(w[:n]) + earlier @ w[n:] + b
        g = weight * (sigmoid(z) - y)
        grad = np.concatenate([np.bincount(flat, g[of], n), earlier.T @ g, [g.sum()]])
        grad[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = scale * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Linear(w, float(b))


def counted(rows: list[np.ndarray], n: int, step: int = 500) -> np.ndarray:
    """How many rows have each feature, a few hundred rows at a time."""
    out = np.zeros(n, np.int64)
    for i in range(0, len(rows), step):
        out += np.bincount(np.concatenate(rows[i : i + step]), minlength=n)
    return out


def select_features(rows: list[np.ndarray], ys: np.ndarray, most: int, least_rows: int = 4) -> dict[int, int]:
    """The features of the largest chi square for any category, numbered from the largest on.

    Only features of ``least_rows`` rows can be; these are counted by category, so that all else is as long as they are many.
    """
    common = np.flatnonzero(counted(rows, 1 << BITS) >= least_rows) if rows else np.zeros(0, np.int64)
    rows, n = renumbered(rows, {f: i for i, f in enumerate(common.tolist())}), len(common)
    best = np.zeros(n)
    for c in range(ys.shape[1]):
        known = ys[:, c] >= 0
        y = ys[known, c]
        if not known.any() or y.min() == y.max():
            continue
        a, b = (counted([r for r, v in zip(rows, ys[:, c], strict=True) if v == x], n) for x in (1, 0))
        p, q = y.sum(), len(y) - y.sum()
        chi = (a * (q - b) - b * (p - a)) ** 2 * len(y) / np.maximum(1, (a + b) * (len(y) - a - b) * p * q)
        chi[a + b < least_rows] = 0
        best = np.maximum(best, chi)
    order = np.argsort(-best, kind="stable")[:most]
    return {int(common[f]): i for i, f in enumerate(order) if best[f] > CHI_SQUARE}


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of the largest F1 on out-of-fold predictions, halfway to the next lower one; 1/2 without both classes."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f[:-1][p[order][:-1] == p[order][1:]] = -1  # a cut between equal predictions isn't one
    i = int(f.argmax())
    return float(p[order[i]] + (p[order[i + 1]] if i + 1 < len(y) else 0)) / 2


def renumbered(rows: list[np.ndarray], kept: dict[int, int]) -> list[np.ndarray]:
    """The rows' kept features, by number."""
    table = np.full(1 << BITS, -1, np.int32)
    table[np.fromiter(kept.keys(), np.int64, len(kept))] = np.fromiter(kept.values(), np.int32, len(kept))
    return [(x := table[r])[x >= 0] for r in rows]


def train(rows: list[np.ndarray], ys: np.ndarray, categories: Sequence[str], most_features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """The chain from feature hashes by row and labels (-1: none); out-of-fold predictions feed the next category."""
    fold = np.arange(len(rows)) % folds
    parts_of = [(np.flatnonzero(fold != f), np.flatnonzero(fold == f)) for f in range(folds)]
    parts_of = [(use, out) for use, out in parts_of if len(use) and len(out)]
    chosen = [select_features([rows[i] for i in use], ys[use], most_features) for use, _ in parts_of]
    seen = [renumbered(rows, kept) for kept in chosen]
    earlier = np.zeros((len(rows), len(categories)))
    for c in range(len(categories)):
        for (use, out), kept, near in zip(parts_of, chosen, seen, strict=True):
            known = use[ys[use, c] >= 0]
            m = train_linear([near[i] for i in known], earlier[known, :c], ys[known, c], len(kept))
            earlier[out, c] = sigmoid(m.logits(Bag([near[i] for i in out]), earlier[out, :c]))
    kept = select_features(rows, ys, most_features) if rows else {}
    near = renumbered(rows, kept)
    models, thresholds = [], []
    for c in range(len(categories)):
        use = np.flatnonzero(ys[:, c] >= 0) if len(rows) else np.zeros(0, int)
        models.append(train_linear([near[i] for i in use], earlier[use, :c], ys[use, c], len(kept)))
        thresholds.append(best_threshold(earlier[use, c], ys[use, c]))
    return Chain(list(categories), kept, models, thresholds)


def labelled_features(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str, sample: int) -> DataFrame:
    """(id, y0 .., f): labels and feature hashes, as bytes, of at most ``sample`` labelled documents, the same ones at each run."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(*(F.max(c.cast("int")).alias(f"y{i}") for i, c in enumerate(categories.values())))
    ys = [f"y{i}" for i in range(len(categories))]
    both = docs.select(F.col(id_col).alias("label_id")).join(known, "label_id").dropDuplicates(["label_id"])
    chosen = both.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "label_id")  # at most ``sample`` ids and labels
    texts = texts.groupBy("label_id").agg(F.min("t").alias("t"), *(F.first(y).alias(y) for y in ys)).select(F.xxhash64("label_id").alias("id"), "t", *ys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Features()
        for b in batches:
            found = [np.array(sorted(seen.of(t)), np.int32).tobytes() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(y).cast(pa.int32()) for y in ys), pa.array(found, pa.binary())], names=["id", *ys, "f"])

    return texts.mapInArrow(run, "id long, " + ", ".join(f"{y} int" for y in ys) + ", f binary")


def in_order(got: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature hashes by row, and labels (-1: none), of :func:`labelled_features`, in the order of their ids."""
    ys = [c for c in got.column_names if c not in ("id", "f")]
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    rows = [np.frombuffer(got.column("f")[int(i)].as_py(), np.int32) for i in order]
    labels = np.column_stack([np.array([-1 if v is None else v for v in got.column(y).to_pylist()], int)[order] for y in ys]) if len(order) else np.zeros((0, len(ys)), int)
    return rows, labels


def sample_features(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """:func:`labelled_features` on the driver, to look at what a model is trained on."""
    return in_order(labelled_features(docs, labels, categories, id_col, text_col, sample).toArrow())


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most_features: int = FEATURES) -> Chain:
    """Trained by one task on the bounded sample, some tens of MB; the driver gets at most most_features weights a category."""
    names = list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows, ys = in_order(pa.Table.from_batches(held)) if held else ([], np.zeros((0, len(names)), int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows, ys, names, most_features).plain)], pa.binary())], names=["chain"])

    made = labelled_features(docs, labels, categories, id_col, text_col, sample).repartition(1).mapInArrow(run, "chain binary").first()
    return chain_of(pickle.loads(made["chain"])) if made else train([], np.zeros((0, len(names)), int), names, most_features)


def label_categories() -> dict[str, Column]:
    """The chain over the label table: low quality first, whose probability the toxic model uses."""
    return {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}


def scored(docs: DataFrame, chain: Chain, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with a probability a category (null and empty texts are scored as empty) and the names of these columns."""
    names = []
    for c in chain.categories:
        names.append(fresh([*docs.columns, *names], f"p_{c}"))
    held = docs.sparkSession.sparkContext.broadcast(chain.plain)  # at most most_features weights a category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chain_of(held.value)
        known = Features(c.kept)
        for b in batches:
            p = c.probabilities(Bag([np.array(sorted(known.of(t.as_py() or "")), np.int64) for t in b.column(at)]))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, i], pa.float64()) for i in range(len(names)))], names=[*b.schema.names, *names])

    at = docs.columns.index(text_col)
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return docs.mapInArrow(run, schema), names


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: dict[str, Column] | None = None, **options) -> DataFrame:
    """One row a row: id, a probability a category, and rejected: whether the last category's probability reaches its threshold.

    Without labelled documents nothing is rejected. Rows with null ids or texts are scored as others.
    """
    chain = train_chain(docs, labels, categories or label_categories(), id_col, text_col, **options)
    rows, names = scored(docs.select(id_col, text_col), chain, text_col)
    return rows.select(id_col, *names, (F.col(names[-1]) >= chain.thresholds[-1]).alias("rejected") if chain.kept else F.lit(False).alias("rejected"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: dict[str, Column] | None = None, **options) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    chain = train_chain(docs, labels, categories or label_categories(), id_col, text_col, **options)
    if not chain.kept:
        return docs
    rows, names = scored(docs, chain, text_col)
    return rows.where(F.col(names[-1]) < chain.thresholds[-1]).select(*docs.columns)
