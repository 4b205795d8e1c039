"""Class-level reachability: which classes the entities of a class lead to over several edges, how, and how many of them.

The classes that a node reaches are bits of a few whole numbers. They travel backward along the edges, a level a step: what
the targets of a node's edges reached newly in the level before is joined by ``bit_or``. The state has one row a node at any
depth, with the bits that are new in each level, which are the distances. So neither nodes that are reached nor paths
are ever rows, and a level costs one exchange of the edges that meet its frontier.

A candidate for a pair of classes is an entity without an edge, in either direction, to the other class; classes that every
entity is linked to directly are not derived. A pair's example is its first candidate by node key that reaches the class,
and the example's path is the first found by a queue that follows the order of edges: from each node the first edge that
leads to a node one step nearer. Examples are followed forward, all pairs at once, a join a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import discard, written

WORD = 64  # classes in a whole number
RECORD = "source_class string, target_class string, relation_pattern array<string>, hops int, example_source string, example_path array<string>, confirmed long, candidates long, confidence double"


def bit(c: Column, word: int) -> Column:
    """The word-th whole number of a set that has the class of this number alone."""
    return F.when(F.floor(c / WORD) == word, F.call_function("shiftleft", F.lit(1).cast("long"), (c % WORD).cast("int"))).otherwise(F.lit(0).cast("long"))


def members(words: list[Column]) -> Column:
    """Numbers of the classes in a set, as an array."""

    def of_word(j: int) -> Column:
        within = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftrightunsigned", words[j], i).bitwiseAND(1) == 1)
        return F.transform(F.when(words[j] == 0, F.array().cast("array<int>")).otherwise(within), lambda i: i + j * WORD)

    return F.concat(*(of_word(j) for j in range(len(words))))


def has(words: Column, c: Column) -> Column:
    """Whether a set, an array of whole numbers, has a class."""
    return F.call_function("shiftrightunsigned", F.element_at(words, (F.floor(c / WORD) + 1).cast("int")), (c % WORD).cast("int")).bitwiseAND(1) == 1


def alive(joined: set[tuple[int, int]], max_depth: int) -> list[set[int]]:
    """By length, from 1, the classes from which ways of so many edges can start, as pairs of classes that edges join allow."""
    out: list[set[int]] = []
    going = {c for c, _ in joined}
    while going and len(out) < max_depth:
        out.append(going)
        going = {c for c, t in joined if t in going}
    return out


def levels(e: DataFrame, joined: set[tuple[int, int]], n_words: int, max_depth: int) -> DataFrame:
    """(node, c, new, seen, by_level) of edges (src, c, dst, t): the sets of classes reached, in all and newly in each level; a row a node with an edge.

    The first level is known from the edges themselves. In later ones only nodes that edges lead to, of classes from which ways
    go on, are looked at; where no class has such ways, the search is over.
    """
    words = range(n_words)
    zero = F.lit(0).cast("long")
    first = e.groupBy(F.col("src").alias("node"), "c").agg(*(F.bit_or(bit(F.col("t"), j)).alias(f"new{j}") for j in words))
    state = written(first.select("node", "c", *(f"new{j}" for j in words), *(F.col(f"new{j}").alias(f"seen{j}") for j in words), F.array(F.array(*(F.col(f"new{j}") for j in words))).alias("by_level")), "reach-1")
    ends = {t for _, t in joined}
    for hop, ways in enumerate(alive(joined, max_depth)[:-1], 2):
        onward = sorted(ends & ways)
        some = F.lit(False)
        for j in words:
            some = some | (F.col(f"new{j}") != 0)
        front = state.where(some & F.col("c").isin(onward)).select(F.col("node").alias("dst"), *(f"new{j}" for j in words))
        if hop > 6 and front.isEmpty():  # few levels are as soon written as looked at
            break
        got = e.where(F.col("t").isin(onward)).select("src", "dst").join(front, "dst").groupBy(F.col("src").alias("node")).agg(*(F.bit_or(f"new{j}").alias(f"got{j}") for j in words))
        here = [F.coalesce(F.col(f"got{j}"), zero) for j in words]
        fresh = [here[j].bitwiseAND(F.bitwise_not(F.col(f"seen{j}"))) for j in words]
        rows = state.join(got, "node", "left").select("node", "c", *(fresh[j].alias(f"new{j}") for j in words), *(F.col(f"seen{j}").bitwiseOR(here[j]).alias(f"seen{j}") for j in words), F.concat("by_level", F.array(F.array(*fresh))).alias("by_level"))
        before, state = state, written(rows, f"reach-{hop}")
        discard(before)
    return state


def example_paths(e: DataFrame, state: DataFrame, pairs: DataFrame, longest: int) -> DataFrame:
    """(c, t, path, relations) of pairs (c, t, source, hops): from each source the first edges that lead nearer.

    All pairs go a step at once. They are broadcast, a row a pair of classes; the edges that they meet are written.
    """
    where = state.select(F.col("node").alias("to"), "by_level")
    steps = e.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("t").alias("to_c"), "rel", "ord")
    going = pairs.select("c", "t", F.col("source").alias("at"), F.col("hops").alias("left"), F.array("source").alias("path"), F.array().cast("array<string>").alias("relations"))
    arrived = None
    for _ in range(longest):
        near = written(steps.join(F.broadcast(going), F.col("at") == F.col("from")), "reach-near")
        last = near.where((F.col("left") == 1) & (F.col("to_c") == F.col("t")))
        before = F.col("left") - 1
        nearer = near.where("left > 1").join(where, "to").where((F.size("by_level") >= before) & has(F.element_at("by_level", before), F.col("t")))
        on = last.unionByName(nearer.drop("by_level")).groupBy("c", "t").agg(F.first(F.struct("left", "path", "relations")).alias("s"), F.min_by(F.struct("to", "rel"), F.struct("ord", "to")).alias("n"))
        on = written(on.select("c", "t", F.col("n.to").alias("at"), (F.col("s.left") - 1).alias("left"), F.concat("s.path", F.array("n.to")).alias("path"), F.concat("s.relations", F.array("n.rel")).alias("relations")), "reach-step")
        discard(near)
        done = on.where("left = 0").select("c", "t", "path", "relations")
        arrived = done if arrived is None else arrived.unionByName(done)
        going = on.where("left > 0")
    return arrived if arrived is not None else going.select("c", "t", "path", "relations")


def reachability(e: DataFrame, ents: DataFrame, max_depth: int = 5) -> DataFrame:
    """A row a pair of classes that several edges connect: RECORD.

    hops, relation_pattern and example_path are those of the example; confirmed counts all candidates that reach the class,
    none of them sampled; confidence is 1 / hops.
    """
    spark = e.sparkSession
    sizes = {r["class"]: r["n"] for r in ents.groupBy("class").agg(F.count("*").alias("n")).collect()}  # a row a class
    classes = sorted(sizes)
    place = {c: i for i, c in enumerate(classes)}
    joined = {(place[r["src_class"]], place[r["dst_class"]]) for r in e.select("src_class", "dst_class").distinct().collect() if r["src_class"] in place and r["dst_class"] in place}  # a row a pair of classes
    if not joined:
        return spark.createDataFrame([], RECORD)
    number = F.broadcast(spark.createDataFrame([(i, c, sizes[c]) for c, i in place.items()], "c int, class string, size long"))
    n_words = -(-len(classes) // WORD)
    named = lambda k, name: number.select(F.col("c").alias(k), F.col("class").alias(name))
    e = e.join(named("c", "src_class"), "src_class").join(named("t", "dst_class"), "dst_class").select("src", "c", "dst", "t", "rel", "ord")
    state = levels(e, joined, n_words, max_depth)

    # classes linked to: of outgoing edges the first level, of incoming ones those of the sources
    into = e.groupBy(F.col("dst").alias("node"), F.col("t").alias("c")).agg(*(F.bit_or(bit(F.col("c"), j)).alias(f"into{j}") for j in range(n_words)))
    rows = state.join(into, ["node", "c"], "full_outer")
    zero = F.lit(0).cast("long")
    direct = [F.coalesce(F.col("by_level")[0][j], zero).bitwiseOR(F.coalesce(F.col(f"into{j}"), zero)) for j in range(n_words)]
    own = [bit(F.col("c"), j) for j in range(n_words)]
    far = [F.coalesce(F.col(f"seen{j}"), zero).bitwiseAND(F.bitwise_not(direct[j])).bitwiseAND(F.bitwise_not(own[j])) for j in range(n_words)]
    hop = lambda t: F.array_position(F.transform("by_level", lambda w: has(w, t)), True).cast("int")
    none = F.lit(None).cast("int")
    items = F.concat(F.transform(members(far), lambda t: F.struct(t.cast("int").alias("t"), hop(t).alias("hops"))), F.transform(members(direct), lambda t: F.struct(t.cast("int").alias("t"), none.alias("hops"))))
    found = rows.select("node", "c", F.explode(items).alias("x")).select("node", "c", "x.t", "x.hops")
    away = F.col("hops").isNotNull()
    found = found.groupBy("c", "t").agg(F.count_if(away).alias("confirmed"), F.count_if(~away).alias("joined"), F.min(F.when(away, F.struct("node", "hops"))).alias("first")).where("confirmed > 0")
    pairs = found.join(number, "c").select("c", "t", F.col("first.node").alias("source"), F.col("first.hops").alias("hops"), "confirmed", (F.col("size") - F.col("joined")).alias("candidates"))
    pairs = written(pairs, "reach-pairs")
    longest = pairs.agg(F.max("hops")).first()[0] or 0
    out = pairs.join(example_paths(e, state, pairs, longest), ["c", "t"]).join(named("c", "source_class"), "c").join(named("t", "target_class"), "t")
    return out.select("source_class", "target_class", F.col("relations").alias("relation_pattern"), "hops", F.col("source").alias("example_source"), F.col("path").alias("example_path"), "confirmed", "candidates", F.bround(1.0 / F.col("hops"), 2).alias("confidence"))
