"""Near-duplicate join by n-gram Jaccard similarity: a MinHash LSH forest, followed by exact verification.

Shingles are five consecutive words, a word a run of letters, digits or underscores, in lower case; a text of fewer
words has one shingle of all its words, and a text without words has none. Links join documents of equal texts, and
documents whose shingle sets have a Jaccard similarity of at least the threshold.

1. Classes: documents of equal texts are one class, known by a digest; all later steps work on classes. So a third of all rows
   may be copies of one text.
2. Forest: a class has ``trees`` MinHash sequences of ``depth`` values, each a path in a prefix tree. The tries are kept as
   sorted prefixes: a node is the hash of (tree, prefix), its members are the classes with that prefix.
3. Descent from the longest prefixes: at each depth, from ``depth`` on, the classes that still ask are compared by their
   whole signatures (a bound several standard errors below the threshold) with all members of their nodes. Then a class
   stops if even the least similar of those it has found would be found at this depth with the target probability; the others
   shorten their prefixes by one. A class that finds nothing is shortened to ``floor``, the depth at which a pair at the
   threshold shares a node with the target probability. So crowded prefixes of nearly equal texts are resolved deep in the
   tries, and only classes with distant or no partners ask for the wider nodes above.
4. What is found joins classes to groups, the connected components of at most one edge a member and block of a node.
   Within a node, members that are already joined aren't compared again. In a node of more than a block, members like the
   node's least class are joined by it, and only the others are dealt with all members into tiles.
5. Within a group all pairs are verified exactly, in tiles of two blocks of bounded size, as products of 0/1 matrices.
   A tile returns counts of links a class and a spanning forest of the verified links, never pairs.
6. Near-duplicate groups are the components of the verified links.

The work of step 5 is the number of pairs within groups of different but alike texts, by matrix products; it is the
only part that grows faster than the input, if such a group does.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, fresh, text_or_empty, written

WORDS, TREES, DEPTH, BLOCK = 5, 24, 8, 512
_word = re.compile(r"\w+")
_mix = np.uint64(0x9E3779B97F4A7C15)


# --- shingles and signatures -------------------------------------------------------------------------------------


class Hashes(dict):
    """Word hashes, kept for words that come again; emptied when there are too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, known: Hashes, n: int = WORDS) -> np.ndarray:
    """64-bit hashes of a text's shingles, repeats included."""
    words = _word.findall(text.lower())
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not words:
        return h
    length = max(1, len(h) - n + 1)
    out = np.full(length, min(len(h), n), np.uint64)
    for j in range(min(n, len(h))):
        out = mixed(out * _mix + h[j : j + length])
    return out


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """16 bits of each of so many MinHashes for each non-empty shingle set."""
    a, b = permutations(count)
    all_ = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), count), np.uint16)
    for i in range(count):
        least = np.minimum.reduceat(all_ * a[i] + b[i], starts)
        out[:, i] = mixed(least) >> np.uint64(48)
    return out


def floor_of(recall: float, threshold: float, trees: int, depth: int) -> int:
    """The longest prefix that a pair at the threshold shares in some tree with this probability, shortened one by one from depth."""
    while depth > 1 and least_found(recall, trees, depth) > threshold:
        depth -= 1
    return depth


def least_found(recall: float, trees: int, depth: int) -> float:
    """The similarity from which on two classes share a prefix of this depth in some tree with this probability."""
    return (1 - (1 - recall) ** (1 / trees)) ** (1 / depth)


def digest(text: str) -> Column:
    """What tells texts apart (null: empty): 128 bits."""
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def signed(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int) -> DataFrame:
    """(id, digest, signature) of each row; the signature is null where there are no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            held: list[np.ndarray] = []
            size, at = 0, []
            sigs: list[bytes | None] = []

            def flush():
                if held:
                    for i, s in zip(at, signatures(held, trees * depth), strict=True):
                        sigs[i] = s.tobytes()
                held.clear()
                at.clear()

            for i, x in enumerate(batch.column(2)):
                sigs.append(None)
                h = shingle_hashes(x.as_py() or "", known)
                if len(h):
                    held.append(h)
                    at.append(i)
                    size += len(h)
                if size > 100_000:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary())], names=["id", "digest", "signature"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest"), text_col).mapInArrow(run, f"id {kind}, digest binary, signature binary")


# --- connected components ----------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for all nodes of (u, v) long edges, root the least node of the component.

    Alternating large and small stars on a table that is written each round; the number of edges never grows. Least
    neighbours come from an aggregate with partial sums, so a node of many edges is no task of its own. Rounds go on until
    the edges no longer change; an error is raised if a given number of rounds isn't enough to see that.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for done in itertools.count():
        if done == rounds:
            raise RuntimeError(f"components have not settled after {rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain exchanges, of which Spark splits those of a hub
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's lesser neighbours and itself are joined to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "cc")
        # settled when both tables have the same edges: equal counts, and no edge of the one lacks in the other
        n = new.count()
        settled = n == before and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        discard(edges, least)
        edges, before = new, n
        if settled:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given ones, toward the least node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in parent if find(x) != x]


# --- candidates --------------------------------------------------------------------------------------------------


def joined_pairs(sig: np.ndarray, asks: np.ndarray, others: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, share): pairs of rows that connect each asking row with the other rows of which so large a share agrees.

    Rows already connected, directly or by others, are not compared again, and each pair connects two components. So rows
    that are all alike cost a comparison or two each and return one pair each, but connect what all alike pairs would.
    """
    component = np.arange(len(sig))
    found: list[tuple[int, int, float]] = []
    for i in asks.tolist():
        left = others[component[others] != component[i]]
        heads = left[np.unique(component[left], return_index=True)[1]]
        for group in (heads, left) if len(heads) < len(left) else (left,):
            group = group[component[group] != component[i]]
            share = (sig[group] == sig[i]).mean(1)
            hit = np.flatnonzero(share >= least)
            for j in hit[np.unique(component[group[hit]], return_index=True)[1]].tolist():
                found.append((i, int(group[j]), float(share[j])))
                component[component == component[group[j]]] = component[i]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, share = zip(*found, strict=True)
    return np.array(a), np.array(b), np.array(share)


def by_group(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run(columns as arrays) -> lists of the schema's columns, for the rows of each key; keys are whole numbers.

    A partition streams in the order of the keys and many small groups are handled in one batch, where a call of its own
    for each group would cost more than its work. No more is held than a batch and the group that it ends in.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handled(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.column_stack([table.column(k).to_numpy() for k in keys])
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            columns = {c: table.column(c).to_numpy() for c in table.column_names}
            out: list[list] = [[] for _ in names]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for have, more in zip(out, run({c: v[lo:hi] for c, v in columns.items()}), strict=True):
                    have.extend(more)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key = np.column_stack([table.column(k).to_numpy() for k in keys])
            last = len(key) - int(np.argmax((key[::-1] != key[-1]).any(1))) if len(key) and (key != key[-1]).any() else 0
            if last:
                yield from handled(table.slice(0, last))
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield from handled(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def tiles(rows: DataFrame, key: str, size: str, block: int, salt: str) -> DataFrame:
    """Deals the rows of a key into blocks of about so many, and each block to the tiles (x <= y) that hold it.

    A key of one block has one tile. Tiles are balanced whatever the size of the key: a third of all rows may share it.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(salt), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("blocks", "other")


def trie_nodes(classes: DataFrame, trees: int, depth: int, floor: int) -> DataFrame:
    """(cls, node_floor .. node_depth) of each class and tree whose shortest prefix another class shares: the tries' inner paths.

    Deeper nodes lie within these, so that all later steps look at paths that share something only.
    """

    def node(t: int, d: int) -> Column:
        return F.xxhash64(F.lit(t), F.substring(F.col("signature"), 2 * depth * t + 1, 2 * d)).alias(f"node_{d}")

    paths = [F.struct(*(node(t, d) for d in range(floor, depth + 1))) for t in range(trees)]
    rows = classes.where(F.col("signature").isNotNull()).select("cls", F.explode(F.array(*paths)).alias("path")).select("cls", "path.*")
    shared = rows.groupBy(f"node_{floor}").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared, f"node_{floor}")


def node_sizes(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, m, pivot) of the keys that have several rows, some of which ask: rows, asking rows and the least class."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("m"), F.min("cls").alias("pivot")).where("n > 1 AND m > 0")


def joined_to_pivots(rows: DataFrame, classes: DataFrame, least: float, block: int) -> DataFrame:
    """(cls, node, pivot, share) of the members of nodes of more than a block: how alike they are to the node's pivot."""
    crowds = node_sizes(rows, "node").where(F.col("n") > block).select("node", "pivot")
    sigs = classes.select("cls", "signature")
    pivots = crowds.join(sigs.toDF("pivot", "pivot_signature"), "pivot")
    members = rows.select("cls", "node").join(pivots, "node").join(sigs, "cls").select("cls", "node", "pivot", "signature", "pivot_signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (3, 4))
            share = (x == y).mean(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.round(share * 1e6).astype(np.int64))], names=["cls", "node", "pivot", "share"])

    return members.mapInArrow(run, "cls long, node long, pivot long, share long")


def asked_tiles(rows: DataFrame, key: str, block: int, salt: str) -> DataFrame:
    """Deals (key, asks, ...) rows into tiles x, y of about ``block`` asking rows and as many of all rows of the key.

    A row is in a tile as one that asks (side 0) or as one to be compared with (side 1). Keys with one row, or with none that
    asks, have no tiles.
    """
    sizes = node_sizes(rows, key)
    sizes = sizes.select(key, F.ceil(F.col("m") / block).cast("int").alias("xs"), F.ceil(F.col("n") / block).cast("int").alias("ys"))
    rows = rows.join(sizes, key)
    cell = lambda n: F.pmod(F.xxhash64(salt), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    with_all = F.transform(all_("xs"), lambda x: at(1, x, cell("ys")))
    asking = F.transform(all_("ys"), lambda y: at(0, cell("xs"), y))
    # one tile holds both sides: a row that asks there is on side 0 only
    one = (F.col("xs") == 1) & (F.col("ys") == 1)
    places = F.when(one, F.array(at(F.when(F.col("asks"), 0).otherwise(1), F.lit(0), F.lit(0)))).when(F.col("asks"), F.concat(with_all, asking)).otherwise(with_all)
    return rows.withColumn("place", F.explode(places)).select(*(c for c in rows.columns if c not in ("xs", "ys")), "place.*")


def compare_node(c: dict[str, np.ndarray], least: float) -> tuple[list, list, list]:
    """(u, v, share in millionths) of the pairs that connect the asking members of a tile with those alike."""
    # a class may be on both sides of a tile
    cls, row = np.unique(c["cls"], return_inverse=True)
    at = np.zeros(len(cls), np.int64)
    at[row] = np.arange(len(row))
    asks = np.unique(row[c["side"] == 0])
    if not len(asks) or len(cls) < 2:
        return [], [], []
    sig = np.frombuffer(b"".join(c["signature"][at]), np.uint16).reshape(len(cls), -1)
    alone = not (c["side"] == 1).any()
    others = np.arange(len(cls)) if alone or c["x"][0] == c["y"][0] == 0 else np.unique(row[c["side"] == 1])
    a, b, share = joined_pairs(sig, asks, others, least)
    return cls[a].tolist(), cls[b].tolist(), np.round(share * 1e6).astype(np.int64).tolist()


def candidate_edges(classes: DataFrame, trees: int, depth: int, floor: int, threshold: float, recall: float, block: int) -> DataFrame:
    """(u, v) edges that connect classes with alike signatures that share a prefix, the longest prefixes first."""
    nodes = written(trie_nodes(classes, trees, depth, floor), "near-tries")
    least = threshold - 5 * (threshold * (1 - threshold) / (trees * depth)) ** 0.5
    found: DataFrame | None = None
    stopped: DataFrame | None = None  # classes that ask no more
    for d in range(depth, floor - 1, -1):
        rows = nodes.select("cls", F.col(f"node_{d}").alias("node"))
        if stopped is None:
            rows = rows.withColumn("asks", F.lit(True))
        else:
            rows = rows.join(stopped.withColumn("asks", F.lit(False)), "cls", "left").withColumn("asks", F.coalesce("asks", F.lit(True)))
        # the members of a crowded node that are like its pivot are joined by it; the others are compared with all members
        crowds = written(joined_to_pivots(rows, classes, least, block), f"near-crowds-{d}")
        alike = crowds.where(F.col("share") >= int(least * 1e6))
        rows = rows.join(crowds.select("cls", "node", (F.col("share") < int(least * 1e6)).alias("unlike")), ["cls", "node"], "left")
        rows = rows.select("cls", "node", F.coalesce("unlike", "asks").alias("asks"))
        members = asked_tiles(rows, "node", block, "cls").join(classes.select("cls", "signature"), "cls")
        pairs = by_group(members, ["node", "x", "y"], lambda c: compare_node(c, least), "u long, v long, share long")
        pairs = written(pairs.unionByName(alike.where("cls <> pivot").select(F.col("cls").alias("u"), F.col("pivot").alias("v"), "share")), f"near-pairs-{d}")
        discard(crowds)
        found = pairs if found is None else found.unionByName(pairs)
        if d > floor:
            enough = int(least_found(recall, trees, d) * 1e6)
            ends = found.select(F.explode(F.array("u", "v")).alias("cls"), "share")
            before, stopped = stopped, written(ends.groupBy("cls").agg(F.min("share").alias("share")).where(F.col("share") >= enough).select("cls"), f"near-stopped-{d}")
            discard(*[before] * (before is not None))
    discard(nodes, *[stopped] * (stopped is not None))
    return found.select("u", "v")


# --- verification ------------------------------------------------------------------------------------------------


def shingle_sets(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with a column of the distinct shingle hashes, as bytes, in place of the text."""
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py() or "", known)).tobytes() for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sets, pa.binary())], names=[*others, "shingles"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{schema}, shingles binary")


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float, width: int = 4096) -> np.ndarray:
    """Whether each set of a and each of b have a Jaccard similarity of at least the threshold; exact."""
    both = np.zeros((len(a), len(b)), np.float32)
    terms, where = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cuts = np.cumsum([len(s) for s in [*a, *b]])[:-1]
    cols = np.split(where, cuts)
    rows_of = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    flat = np.concatenate(cols) if cols else np.zeros(0, int)
    order = np.argsort(flat, kind="stable")
    flat, rows_of = flat[order], rows_of[order]
    for start in range(0, len(terms), width):  # 0/1 matrices of some thousand shingles at a time; counts are exact in float32
        lo, hi = np.searchsorted(flat, [start, start + width])
        m = np.zeros((len(cols), min(width, len(terms) - start)), np.float32)
        m[rows_of[lo:hi], flat[lo:hi] - start] = 1
        both += m[: len(a)] @ m[len(a) :].T
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    union = na[:, None] + nb[None, :] - both
    return (both > 0) & (both >= threshold * union - 1e-6)


def verified(groups: DataFrame, threshold: float, block: int) -> DataFrame:
    """(u, v, links) from (root, n, cls, copies, shingles): with v null, the documents linked to u in a tile; else a link."""
    members = tiles(groups, "root", "n", block, "cls")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        own, cls, copies = pdf["own"].to_numpy(), pdf["cls"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": [], "links": []}).astype({"u": "int64", "v": "Int64", "links": "int64"})
        hit = linked([sets[i] for i in left], [sets[i] for i in right], threshold)
        if x == y:
            np.fill_diagonal(hit, False)
        counts = [(cls[left], hit @ copies[right])] + ([(cls[right], hit.T @ copies[left])] if x != y else [])
        u = np.concatenate([c[0] for c in counts])
        links = np.concatenate([c[1] for c in counts])
        a, b = np.nonzero(hit)
        tree = forest(cls[left][a], cls[right][b])
        out = pd.DataFrame({"u": u[links > 0], "v": pd.array([pd.NA] * int((links > 0).sum()), "Int64"), "links": links[links > 0]})
        more = pd.DataFrame({"u": [e[0] for e in tree], "v": pd.array([e[1] for e in tree], "Int64"), "links": np.zeros(len(tree), np.int64)})
        return pd.concat([out, more]) if len(more) else out

    return members.groupBy("root", "x", "y").applyInPandas(run, "u long, v long, links long")


# --- the join ----------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, trees: int = TREES, depth: int = DEPTH, recall: float = 0.999, block: int = BLOCK) -> DataFrame:
    """One row a row: id, class_id, copy_id, n_copies, n_links, group_key.

    class_id is the least id of the near-duplicate group (the components of all links), copy_id the least id among equal
    texts, n_copies their number, n_links the number of other rows that are linked to this one; group_key is a number of
    the group, which differs from run to run. Null texts equal empty ones; texts without words are linked to equal texts
    only. A null id is no least id: a group of null ids only has a null class_id. Repeated rows are copies of each other.
    """
    best = near_classes(docs, id_col, text_col, threshold, trees, depth, recall, block)
    rows = docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest"))
    return rows.join(best, "digest").select(F.col("id").alias(id_col), "class_id", "copy_id", "n_copies", "n_links", "group_key")


def near_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, trees: int = TREES, depth: int = DEPTH, recall: float = 0.999, block: int = BLOCK) -> DataFrame:
    """(digest, class_id, copy_id, n_copies, n_links, group_key) of each class of equal texts."""
    classes = signed(docs, id_col, text_col, trees, depth).groupBy("digest").agg(F.min("id").alias("copy_id"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    # numbers of the classes, fixed by the written table
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "near-classes")
    floor = floor_of(recall, threshold, trees, depth)
    groups = written(components(candidate_edges(classes, trees, depth, floor, threshold, recall, block)), "near-groups")
    sized = groups.join(groups.groupBy("root").agg(F.count("*").alias("n")), "root")
    members = sized.join(classes.select(F.col("cls").alias("node"), "digest", "copy_id", "copies"), "node").withColumnRenamed("node", "cls")
    # a class's text is that of a row with its least id and its digest
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), digest(text_col).alias("digest"))
    texts = texts.join(members, (texts["digest"] == members["digest"]) & texts["id"].eqNullSafe(members["copy_id"])).select("text", "root", "n", "cls", "copies")
    sets = shingle_sets(texts, "text").dropDuplicates(["cls"])  # repeated rows
    found = written(verified(sets, threshold, block), "near-links")
    links = found.where("v IS NULL").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    near = components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "cls")
    best = classes.select("cls", "digest", "copy_id", "copies").join(near, "cls", "left").join(links, "cls", "left")
    best = best.withColumn("group_key", F.coalesce("root", "cls"))
    ids = best.groupBy("group_key").agg(F.min("copy_id").alias("class_id"))
    return best.join(ids, "group_key").select("digest", "class_id", "copy_id", F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "group_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the least id, ties by text; null ids only if there is no other."""
    best = near_classes(docs, id_col, text_col, **options)
    d, keep, nth = (fresh(docs.columns, x) for x in ("near_digest", "near_keep", "near_nth"))
    # the class that holds the group's least id; among several, that of the least digest
    first = best.groupBy("group_key").agg(F.min(F.struct(F.col("copy_id").isNull(), "copy_id", "digest")).alias("first"))
    first = first.select(F.col("first.digest").alias(d), F.col("first.copy_id").alias(keep))
    rows = docs.withColumn(d, digest(text_col)).join(first.withColumnRenamed(d, d + "2"), (F.col(d) == F.col(d + "2")) & F.col(id_col).eqNullSafe(F.col(keep)))
    # repeated rows of that id and text: any one of them
    w = Window.partitionBy(d).orderBy(F.monotonically_increasing_id())
    return rows.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).select(*docs.columns)
