"""From a question's words to a plan, and from a plan to a result.

Three steps, each a plain data structure: words become a tree of scopes (what is meant), the scopes a tree of operations
(what is to be done, with the rewrites that need the workbook), and the operations a flat plan of opcodes with arguments. A
plan is folded over an immutable state whose tables are lazy DataFrames; only what a result names singly is collected. Opcodes
are functions in a table, to which others can be added (:func:`opcode`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import compare, derive, explore, graph, integrity, relational

from .language import CONCEPTS

if TYPE_CHECKING:
    from .session import Engine

# The names of operations.
OPERATIONS = ("GROUP", "COUNT", "SUM", "AVG", "MIN", "MAX", "FILTER", "JOIN", "SORT_ASC", "SORT_DESC", "LIMIT", "DISTINCT", "COMPARE", "PATH", "DEPENDENCY", "REACHABILITY", "EXPLAIN", "SEARCH", "SHOW", "OPEN", "COUNT_RELATED", "REVERSE", "EVIDENCE")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
ON_ROWS = (*AGGREGATES, "GROUP", "FILTER", "SORT_ASC", "SORT_DESC", "LIMIT", "DISTINCT", "SHOW")
ON_NODES = ("PATH", "DEPENDENCY", "REACHABILITY", "COUNT_RELATED", "REVERSE", "EVIDENCE", "EXPLAIN", "COMPARE")


# --- scopes ----------------------------------------------------------------------------------------------------------


@dataclass
class Meaning:
    """What a word stands for: a concept, a registry or relation of the workbook, an entity, a number, or nothing known."""

    kind: str  # concept, workbook, entity, ambiguous, number, unresolved
    text: str
    canonical: str = ""
    type: str = ""
    value: float = 0
    candidates: tuple = ()


@dataclass
class Scope:
    """One part of a question: a target and the concepts and numbers that go with it."""

    label: str
    target: Meaning | None = None
    concepts: list[str] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    children: list[Scope] = field(default_factory=list)

    def walk(self) -> Iterator[Scope]:
        yield self
        for c in self.children:
            yield from c.walk()


def scopes(meanings: Sequence[Meaning]) -> Scope:
    """A qualifier (top, first, distinct ...) heads a scope of its own below the root, and so does a second target of a scope."""
    root = here = Scope("root")
    for m in meanings:
        if m.kind == "number":
            here.values.append(m.value)
        elif m.kind == "concept":
            if m.type == "QUALIFIER":
                here = Scope(m.canonical.lower())
                root.children.append(here)
            if m.type not in ("QUESTION", "LOGIC"):
                here.concepts.append(m.canonical)
        elif m.kind in ("workbook", "entity"):
            if here.target is None:
                here.target = m
            else:
                here.children.append(Scope(m.text, m))
    return root


# --- operations ------------------------------------------------------------------------------------------------------


@dataclass
class Task:
    """Operations on one target, before they are turned into opcodes."""

    scope: str
    target: str | None
    is_entity: bool
    operations: list[str]
    values: list[float] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    children: list[Task] = field(default_factory=list)

    def walk(self) -> Iterator[Task]:
        yield self
        for c in self.children:
            yield from c.walk()


def tasks(scope: Scope) -> Task:
    """Each scope's operations in the order of its words, each once; a scope of a bare target opens it."""
    ops = list(dict.fromkeys(op for c in scope.concepts for op in CONCEPTS[c][2]))
    if not ops and scope.target is not None:
        ops = ["OPEN"]
    t = scope.target
    return Task(scope.label, t and t.canonical, bool(t and t.kind == "entity"), ops, list(scope.values), {}, [tasks(c) for c in scope.children])


def resolved(task: Task, engine: Engine) -> Task:
    """The rewrites that look at the workbook: qualifiers take the root's target, then counts, paths and filters over relations."""
    for rule in (lifted_qualifier, related_count, path_of_two, scoped_filter):
        task = rule(task, engine)
    return task


def lifted_qualifier(task: Task, engine: Engine) -> Task:
    """'joints, the top 3': a qualifier's scope without a target works on the root's; a root without anything is its one child."""
    for c in task.children:
        if c.target is None and task.target is not None and c.operations:
            c.target, c.is_entity = task.target, task.is_entity
            if task.operations == ["OPEN"]:
                task.operations = []
    if task.target is None and not task.operations and len(task.children) == 1:
        return replace(task.children[0], values=task.values + task.children[0].values)
    return task


def related_count(task: Task, engine: Engine) -> Task:
    """A count with two classes, or a class and an entity, counts what a relation between them connects."""
    if not any(op in (*AGGREGATES, "GROUP") for op in task.operations) or task.target is None:
        return task
    child = next((c for c in task.children if c.target is not None), None)
    if child is None:
        return task
    ends = [(t.target, engine.node_of(t.target) if t.is_entity else None) for t in (task, child)]
    classes = [engine.class_of(node) if node else name for name, node in ends]
    relation, direction = engine.relation_between(*classes)
    # the counted class is the first one named, unless an entity is: then the other
    counted, anchor = (0, 1) if ends[0][1] is None else (1, 0)
    flip = {"out": "in", "in": "out"}
    params = {"relation": relation, "parent_class": classes[anchor], "child_class": classes[counted], "direction": direction if anchor == 1 else flip[direction], "parent": ends[anchor][1]}
    return replace(task, operations=["COUNT_RELATED"], params=params, children=[c for c in task.children if c is not child])


def path_of_two(task: Task, engine: Engine) -> Task:
    """A path, or a comparison, with two entities is between them."""
    named = [t.target for t in task.walk() if t.is_entity]
    for op in ("PATH", "COMPARE"):
        holder = next((t for t in task.walk() if op in t.operations), None)
        if holder is not None and len(named) >= 2:
            return Task(holder.scope, named[0], True, [op], [], {"source": named[0], "target": named[1]})
    return task


def scoped_filter(task: Task, engine: Engine) -> Task:
    """'joints in ACT-1': a class and an entity, with nothing else to do than to show or filter, are the class's members at the entity."""
    if any(op not in ("FILTER", "OPEN", "SHOW") for t in task.walk() for op in t.operations):
        return task
    named = next((t for t in task.walk() if t.is_entity), None)
    of = next((t for t in task.walk() if t.target is not None and not t.is_entity and engine.wb.sheet(t.target)), None)
    if named is None or of is None:
        return task
    return Task(task.scope, named.target, True, ["REVERSE"], [], {"source_class": of.target})


# --- plans -----------------------------------------------------------------------------------------------------------

Plan = list[tuple[str, dict[str, Any]]]


def realized(op: str, values: Sequence[float]) -> Plan:
    """Opcodes of an operation."""
    if op in AGGREGATES:
        return [("aggregate", {"fn": op.lower()})]
    if op in ("SORT_ASC", "SORT_DESC"):
        return [("sort", {"descending": op == "SORT_DESC"})]
    if op == "LIMIT":
        return [("limit", {"n": values[0]} if values else {})]
    return [(op.lower(), {})]


def compiled(task: Task) -> Plan:
    """Depth first; a task whose operations need its target's rows or node begins by seeding them."""
    plan: Plan = []
    if task.target is not None and any(op in ON_ROWS or op in ON_NODES for op in task.operations):
        plan.append(("seed", {"token": task.target}))
    for op in task.operations:
        args = {"token": task.target} if op in ("OPEN", "SEARCH") and task.target else {}
        plan += [(name, {**args, **kw, **task.params}) for name, kw in realized(op, task.values)]
    for c in task.children:
        plan += compiled(c)
    return plan


def query_plan(query: dict[str, Any] | None) -> Plan:
    """The plan of a canonical query; of none that is known, the entity itself."""
    seed: Plan = [("seed", {})]
    if query is None:
        return seed
    show: Plan = [("attach_evidence", {}), ("render", {"form": query["render"]})]
    if query["objective"] == "traverse":
        rel = query["relation"]
        return [*seed, ("walk", {"direction": query["direction"], "relation": None if rel == "*" else rel}), *show]
    if query["objective"] == "attribute":
        return [*seed, *show]
    return [*seed, ("check_keys", {}), ("render", {"form": query["render"]})]


def query_plan_for(engine: Engine, query: dict[str, Any] | None, node: str) -> Plan:
    """The plan for one entity: a relation that it lacks, but into whose class several edges lead, becomes a discovery."""
    plan = query_plan(query)
    if query is None or query["objective"] != "traverse" or query["relation"] == "*":
        return plan
    rel = query["relation"]
    if not graph.neighbors(engine.adjacency, node).where(F.col("rel") == rel).isEmpty():
        return plan
    cls = engine.class_of(node)
    targets = explore.relation_classes(engine.relation_targets, engine.reachability, rel, cls)
    far = engine.reachability.where((F.col("source_class") == cls) & F.col("target_class").isin(targets)).orderBy("hops", "target_class").first()
    if far is None:
        return plan
    step = {"target_class": far["target_class"], "relation": rel, "hops": far["hops"], "confirmed": f"{far['confirmed']}/{far['candidates']}"}
    return [plan[0], ("walk_discovery", step), *plan[2:]]


# --- running ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class State:
    """What the opcodes so far made; tables are lazy."""

    token: str | None = None
    node: str | None = None
    registry: str | None = None
    rows: DataFrame | None = None
    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    groups: DataFrame | None = None
    metrics: DataFrame | None = None
    evidence: DataFrame | None = None
    result: Any = None
    words: tuple[str, ...] = ()  # that mean nothing else: column names, search terms
    trace: tuple[str, ...] = ()


Opcode = Callable[..., State]
OPCODES: dict[str, Opcode] = {}


def opcode(f: Opcode) -> Opcode:
    """Adds a function of (engine, state, **arguments) to the table, under its name."""
    OPCODES[f.__name__.rstrip("_")] = f
    return f


def run(engine: Engine, plan: Plan, token: str | None = None, words: Sequence[str] = ()) -> State:
    def step(state: State, item: tuple[str, dict[str, Any]]) -> State:
        name, kw = item
        if name not in OPCODES:
            raise KeyError(f"there is no opcode {name!r}")
        return replace(OPCODES[name](engine, state, **kw), trace=(*state.trace, name))

    return reduce(step, plan, State(token=token, words=tuple(words)))


def _column(engine: Engine, s: State) -> str | None:
    """A column of the registry that the question names."""
    if s.registry is None:
        return None
    known = {w.lower() for w in s.words}
    return next((c for c in engine.wb.header(s.registry) if c.lower() in known), None)


@opcode
def seed(engine: Engine, s: State, token: str | None = None) -> State:
    """A registry's rows, or an entity's node and row."""
    token = token or s.token
    if token and engine.wb.sheet(token):
        rows = engine.wb.rows(token)
        return replace(s, token=token, registry=token, node=None, rows=rows, groups=None, result=rows)
    node = engine.node_of(token) if token else None
    rows = engine.entities.where(F.col("node_key") == node) if node else engine.entities.limit(0)
    return replace(s, token=token, node=node, registry=None, rows=rows, groups=None, result=rows)


@opcode
def group(engine: Engine, s: State, column: str | None = None) -> State:
    return s if s.rows is None else replace(s, groups=relational.grouped_count(s.rows, column or _column(engine, s)))


@opcode
def aggregate(engine: Engine, s: State, fn: str, column: str | None = None) -> State:
    """Counts are a number; other functions work on a column that the question names, and count without one."""
    if s.rows is None:
        return s
    column = column or _column(engine, s)
    if fn == "count":
        return replace(s, metrics=relational.aggregate(s.rows, "count"), result=s.rows.count())
    out = relational.aggregate(s.rows, fn, column)
    return replace(s, metrics=out, result=out)


@opcode
def filter_(engine: Engine, s: State, column: str | None = None, value: object = None) -> State:
    """Without a column no row fits, as in the operation itself."""
    rows = s.rows if s.rows is None else relational.filtered(s.rows, column, value)
    return replace(s, rows=rows, result=rows)


@opcode
def sort(engine: Engine, s: State, descending: bool = False, column: str | None = None) -> State:
    """Groups by their counts, rows by a column (the one that the question names, or the label)."""
    if s.groups is not None:
        out = relational.ordered_metrics(s.groups, "n", descending)
        return replace(s, groups=out, result=out)
    if s.rows is None or s.registry is None:
        return s
    sheet = engine.wb.sheet(s.registry)
    rows = relational.ordered(s.rows, column or _column(engine, s) or sheet.label or sheet.pk, descending)
    return replace(s, rows=rows, result=rows)


@opcode
def limit(engine: Engine, s: State, n: object = 10) -> State:
    """The first n of what there is, in its order."""
    table = s.groups if s.groups is not None else s.rows
    if table is None:
        return s
    sorted_ = "sort" in s.trace
    out = table.limit(relational.count_of(n)) if sorted_ or s.groups is not None or s.registry is None else relational.limited(table, n)
    return replace(s, result=out, **({"groups": out} if s.groups is not None else {"rows": out}))


@opcode
def distinct(engine: Engine, s: State) -> State:
    if s.rows is None or s.registry is None:
        return s
    rows = relational.distinct_entities(s.rows, engine.wb.sheet(s.registry).pk)
    return replace(s, rows=rows, result=rows)


@opcode
def show(engine: Engine, s: State) -> State:
    return s if s.result is not None else replace(s, result=s.rows)


@opcode
def join(engine: Engine, s: State, right: DataFrame | None = None, left_key: str = "", right_key: str = "") -> State:
    if s.rows is None or right is None:
        return s
    rows = relational.joined(s.rows, right, left_key, right_key)
    return replace(s, rows=rows, result=rows)


@opcode
def compare_(engine: Engine, s: State, source: str | None = None, target: str | None = None) -> State:
    a, b = (engine.node_of(x) if x else None for x in (source or s.token, target))
    return replace(s, result=compare.compare_pair(engine.edges, a, b) if a and b else None)


@opcode
def path(engine: Engine, s: State, source: str | None = None, target: str | None = None) -> State:
    a, b = (engine.node_of(x) if x else None for x in (source or s.token, target))
    return replace(s, result=graph.path_between(engine.adjacency, a, b) if a and b else None)


def _around(engine: Engine, s: State, direction: str) -> State:
    edges = graph.neighbors(engine.adjacency, s.node, direction) if s.node else None
    return replace(s, edges=edges, nodes=edges and edges.select(F.col("other").alias("node")).distinct(), result=edges)


@opcode
def dependency(engine: Engine, s: State) -> State:
    return _around(engine, s, "in")


@opcode
def reachability(engine: Engine, s: State) -> State:
    return _around(engine, s, "out")


@opcode
def reverse(engine: Engine, s: State, relation: str | None = None, source_class: str | None = None) -> State:
    if s.node is None:
        return replace(s, result=None)
    out = graph.reverse_lookup(engine.adjacency, engine.entities, s.node, relation)
    out = out.where(F.col("src_class") == source_class) if source_class else out
    return replace(s, edges=out, result=out)


@opcode
def count_related(engine: Engine, s: State, relation: str | None, parent_class: str, child_class: str, direction: str = "out", parent: str | None = None) -> State:
    out = graph.count_related(engine.edges, relation, parent_class, child_class, direction, parent)
    return replace(s, metrics=out, result=out.first()["n"])


@opcode
def evidence(engine: Engine, s: State) -> State:
    out = s.rows.select("class", "pk", "evidence", "metadata") if s.node else None
    return replace(s, evidence=out, result=out)


@opcode
def explain(engine: Engine, s: State) -> State:
    return replace(s, result=engine.discover(s.token) if s.token else None)


@opcode
def search(engine: Engine, s: State, token: str | None = None) -> State:
    term = " ".join(s.words) or token or s.token
    return replace(s, result=engine.search(term) if term else None)


@opcode
def open_(engine: Engine, s: State, token: str | None = None) -> State:
    """A registry's members, or what an entity is."""
    return replace(s, token=token or s.token, result=engine.open_entity(token or s.token))


@opcode
def walk(engine: Engine, s: State, direction: str = "out", relation: str | None = None, flow: str | None = None) -> State:
    """Edges of a relation, equal or part of the name; an outgoing relation without edges is followed over several."""
    if s.node is None:
        return s
    edges = graph.walk_from(engine.adjacency, s.node, direction, relation, flow)
    if relation and direction == "out" and not flow and edges.isEmpty():
        far = graph.discovered_by_relation(engine.adjacency, s.node, relation, engine.reachability, engine.class_of(s.node), engine.relation_targets)
        return replace(s, nodes=far, result=far)
    return replace(s, edges=edges, nodes=edges.select(F.col("other").alias("node")).distinct(), result=edges)


@opcode
def walk_discovery(engine: Engine, s: State, target_class: str, relation: str | None = None, hops: int | None = None, confirmed: str | None = None) -> State:
    """A planned walk over several edges to a class: the nodes with their paths."""
    if s.node is None:
        return s
    far = graph.all_reachable_paths(engine.adjacency, s.node, target_class, reach=engine.reachability, source_class=engine.class_of(s.node))
    return replace(s, nodes=far, result=far)


@opcode
def attach_evidence(engine: Engine, s: State) -> State:
    """Evidence of the edges found, or of the entity."""
    if s.edges is not None:
        return replace(s, evidence=s.edges.where("evidence IS NOT NULL").select(F.concat("node", F.lit("->"), "other").alias("key"), "evidence"))
    if s.rows is not None and s.node is not None:
        return replace(s, evidence=derive.attach_evidence(engine.edges.limit(0), s.rows))
    return s


@opcode
def check_keys(engine: Engine, s: State) -> State:
    out = integrity.check_fk(engine.wb, engine.entities)
    if s.node:
        out = out.where((F.col("registry") == engine.class_of(s.node)) & (F.col("pk") == engine.pk_of(s.node)))
    return replace(s, rows=out, result=out)


@opcode
def render(engine: Engine, s: State, form: str = "table") -> State:
    if form in ("tree", "graph") and s.edges is not None:
        return replace(s, result=derive.render_tree(s.edges, s.node) if form == "tree" else derive.render_edges(s.edges))
    if form == "list" and s.rows is not None:
        return replace(s, result=derive.render_list(s.rows))
    return s if s.result is not None else replace(s, result=s.rows)


def looks_like_number(text: str) -> bool:
    return bool(re.fullmatch(r"\d+(\.\d+)?", text))


__all__ = ["OPCODES", "OPERATIONS", "Meaning", "Plan", "Scope", "State", "Task", "compiled", "opcode", "query_plan", "query_plan_for", "realized", "resolved", "run", "scopes", "tasks"]
