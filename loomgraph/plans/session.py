"""The engine: a compiled workbook and the questions that can be asked of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import capability, compare, derive, discovery, explore, graph, identity, integrity, relational
from loomgraph.operators.adjacency import Adjacency, adjacency
from loomgraph.operators.textindex import TextIndex, normal, text_index
from loomgraph.sources import sinks, workbook
from loomgraph.sources.workbook import Workbook
from loomgraph.storage import written

from . import language, planner


KEPT = ("entities", "edges", "adjacency", "names", "grams", "promoted", "reachability", "targets", "cells")  # tables that an engine holds

ADJACENCY_AFTER = 20  # looks at edges of single nodes that scan the edges, before the adjacency is built for them


class Engine:
    """Entities and edges are written once; every question is a plan over these two tables.

    Results that name single entities are small dicts; all else are DataFrames.
    """

    def __init__(self, wb: Workbook):
        self.wb = wb if wb.catalog else discovery.prepared(wb)
        self.spark = wb.spark
        self.looked_around = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        return cls(workbook.load(spark, path))

    @classmethod
    def from_rows(cls, spark: SparkSession, sheets: Mapping[str, Sequence[Sequence[object]]]) -> Engine:
        return cls(workbook.from_rows(spark, sheets))

    @cached_property
    def entities(self) -> DataFrame:
        return written(identity.entities(self.wb), "entities")

    @cached_property
    def edges(self) -> DataFrame:
        # sorted by their sources in each file, so that lookups by source read few pages; the joins have dealt them already
        return written(graph.edges(self.wb, self.entities).sortWithinPartitions("src"), "edges")

    @cached_property
    def adjacency(self) -> Adjacency:
        """The edges at both of their ends, for what starts at nodes."""
        return adjacency(self.edges)

    @property
    def near(self) -> DataFrame | Adjacency:
        """The edges for what looks at those of single nodes: by scans at first, which need no exchange, then by the adjacency."""
        self.looked_around += 1
        return self.adjacency if self.looked_around > ADJACENCY_AFTER or "adjacency" in self.__dict__ else self.edges

    @cached_property
    def names(self) -> TextIndex:
        """What entities are called, for lookups by names, phrases and parts of names."""
        return text_index(self.entities)

    @cached_property
    def relation_targets(self) -> DataFrame:
        return written(graph.relation_targets(self.edges), "targets")

    @cached_property
    def promoted(self) -> DataFrame:
        return written(derive.promotion_candidates(self.wb), "promoted")

    @cached_property
    def reachability(self) -> DataFrame:
        return written(graph.reachability(self.edges, self.entities), "reachability")

    @cached_property
    def vocabulary(self) -> language.Vocabulary:
        """Grammar words, then registries (with and without their suffix), relations and columns. Names are in an index of their own."""
        v = language.grammar()
        for s in self.wb.owners():
            for w in {s.name, s.name.removesuffix(" Registry"), s.entity or s.name}:
                for form in {w.lower(), w.lower() + "s", S.singular(w)}:
                    v.add(form, s.name, "registry", "workbook")
        for r in self.edges.select("rel").distinct().orderBy("rel").collect():
            v.add(r["rel"].replace("_", " "), r["rel"], "relation", "workbook", 0.5)
        for s in self.wb.owners():
            for c in self.wb.header(s.name):
                v.add(c, f"{s.name}.{c}", "attribute", s.name, 0.4)
        return v

    # --- lookups -------------------------------------------------------------------------------------------------

    def resolve(self, token: str) -> identity.Resolution:
        return identity.resolve(self.entities, token, lambda: self.promoted, index=self.names)

    def node(self, token: str) -> str | None:
        found = self.resolve(token).one
        return found and found["node_key"]

    def _node(self, token: str) -> str:
        key = self.node(token)
        if key is None:
            raise KeyError(f"{token!r} names no single entity")
        return key

    def search(self, term: str) -> DataFrame:
        return relational.ranked_search(self.entities, term)

    def list_entities(self, prefix: str) -> DataFrame:
        return identity.list_entities(self.entities, prefix)

    def contexts(self) -> list[str]:
        return [s.name for s in self.wb.owners()]

    def resolve_context(self, word: str) -> str | None:
        """The registry that a word names, in singular or plural."""
        w = S.singular(word)
        return next((c for c in self.contexts() if w in c.lower().split() or S.singular(c.lower().removesuffix(" registry")) == w), None)

    def query_in_context(self, registry: str, term: str) -> DataFrame:
        return relational.ranked_search(self.entities.where(F.col("class") == registry), term)

    # --- graph ---------------------------------------------------------------------------------------------------

    def discovery_chain(self, token: str) -> DataFrame:
        return graph.discovery_chain(self.near, self.entities, self._node(token))

    def relation_view(self, token: str) -> DataFrame:
        return graph.relation_view(self.near, self._node(token))

    def perspective(self, token: str, direction: str = "out", max_hops: int = 6) -> DataFrame:
        return graph.perspective(self.adjacency, self._node(token), direction, max_hops)

    def derive_table(self, token: str, direction: str = "out", max_hops: int = 6) -> DataFrame:
        return graph.derive_table(self.perspective(token, direction, max_hops), self.entities)

    def intersect(self, a: str, b: str, direction: str = "out", max_hops: int = 6) -> DataFrame:
        return graph.intersect(self.adjacency, self._node(a), self._node(b), direction, max_hops)

    def suggest_next(self, token: str, direction: str = "both", limit: int = 8) -> DataFrame:
        return graph.suggest_next(self.adjacency, self.entities, self._node(token), direction, limit)

    def list_by_relation(self, relation: str) -> DataFrame:
        return graph.list_by_relation(self.edges, self.entities, relation)

    def dimensions(self, token: str) -> DataFrame:
        return compare.dimensions(self.edges, self._node(token))

    def compare(self, token: str, scope: str) -> DataFrame:
        """Against another entity, or against a scope: layer, downstream, upstream or siblings."""
        node = self._node(token)
        if scope in ("layer", "downstream", "upstream", "siblings"):
            return compare.compare_group(self.near, node, compare.scope(self.near, self.entities, node, scope))
        return compare.compare_pair(self.edges, node, self._node(scope))

    def _known(self, token: str) -> tuple[str, str]:
        one = self.resolve(token).one
        if one is None:
            raise KeyError(f"{token!r} names no single entity")
        return one["node_key"], one["class"]

    def reachable_relations(self, token: str) -> DataFrame:
        return explore.reachable_relations(self.near, self.reachability, *self._known(token))

    def discover_relation(self, token: str, relation: str) -> DataFrame:
        node, cls = self._known(token)
        return explore.discover_relation(self.adjacency, node, explore.relation_classes(self.relation_targets, self.reachability, relation, cls))

    def relation_inventory(self, token: str) -> DataFrame:
        return explore.relation_inventory(self.edges, self._node(token), self.near)

    def entity_actions(self, token: str) -> DataFrame:
        return explore.actions(self.edges, self.reachability, *self._known(token))

    def menu(self, token: str) -> DataFrame:
        """All actions of an entity, merged by identity, with their provenance."""
        node, cls = self._known(token)
        return capability.menu(self.adjacency, self.entities, self.reachability, self.relation_targets, node, cls, self.wb.header(cls))

    def applicable_queries(self, token: str) -> DataFrame:
        return explore.applicable_queries(self.near, self.reachability, *self._known(token))

    def describe(self, token: str) -> list[dict]:
        return explore.entity_capabilities(self.entities, self.edges, self._node(token))

    def analyze(self, token: str) -> DataFrame:
        return explore.analyze(self.edges, self.entities, self.reachability, self._node(token))

    def lifecycle(self, token: str) -> DataFrame:
        return explore.lifecycle(self.edges, self.entities, self._node(token))

    def entity_row(self, token: str) -> dict | None:
        r = self.entities.where(F.col("node_key") == self._node(token)).first()
        return r and r["metadata"]

    def observe(self, token: str) -> dict[str, object]:
        node = self.node_of(token)
        return integrity.observe(self.wb, token, self.entities, node and graph.neighbors(self.near, node))

    def diagnose(self, text: str) -> explore.Diagnosis:
        answer = self.ask(text)
        return explore.diagnose(self.checks(), answer["execution"].target is not None, answer["operations"], answer["result"] is not None)

    def discover(self, query: str, context: str | None = None, max_hops: int = 6) -> dict:
        """What a token is and, from a context, the path to it with the confidence of its hops."""
        r = self.resolve(query)
        if r.one is None:
            if r.found:
                return {"status": "ambiguous", "candidates": [c | {"confidence": round(0.9 - 0.05 * i, 2)} for i, c in enumerate(r.found)]}
            return {"status": "unknown", "closest": [x.asDict() for x in self.search(query).limit(8).collect()]}
        out = {"status": "resolved", "target": r.one, "path": [], "reachable": True, "distance": 0, "confidence": 1.0, "weakest_tier": "L1"}
        if context is None:
            return out
        hops = graph.path_between(self.adjacency, self._node(context), r.one["node_key"], max_hops)
        if hops is None:
            return out | {"source": context, "reachable": False, "distance": None, "confidence": 0.0, "weakest_tier": None}
        tiers = {x["rel"]: (x["tier"], x["confidence"]) for x in derive.relation_tiers(self.edges).collect()}  # a row a relation
        confidence = 1.0
        for h in hops:
            h["tier"], h["confidence"] = tiers[h["relation"]]
            confidence *= h["confidence"]
        return out | {"source": context, "path": hops, "distance": len(hops), "confidence": round(confidence, 3), "weakest_tier": max((h["tier"] for h in hops), default="L1")}

    def explain_relation(self, token: str, relation: str) -> dict:
        """Direct targets of a relation, or those that several edges lead to, in all classes it leads into, or why there are none."""
        rel, _, cls = relation.partition("::")
        node, own = self._known(token)
        rows = graph.neighbors(self.near, node).where(F.col("rel") == rel)
        if cls:
            rows = rows.where(F.col("other_class") == cls)
        if not rows.isEmpty():
            return {"entity": token, "relation": relation, "mode": "direct", "items": rows.select("dir", "other", "evidence")}
        targets = [t for t in explore.relation_classes(self.relation_targets, self.reachability, rel, own) if not cls or t == cls]
        far = graph.reached_in(self.adjacency, node, targets)
        if not far.isEmpty():
            return {"entity": token, "relation": relation, "mode": "discovered", "items": far}
        return {"entity": token, "relation": relation, "mode": "empty", "items": rows.select("dir", "other", "evidence"), "reason": f"no edge or path of {rel} starts at {token}"}

    @cached_property
    def queries(self) -> dict[str, dict]:
        """The canonical queries and one a relation, by name."""
        return {r["name"]: r.asDict() for r in derive.workbook_queries(self.edges).collect()}  # a row a relation

    def answer(self, query: str, token: str) -> dict:
        """A canonical query of an entity, by its plan; unknown names give a note."""
        q = self.queries.get(query)
        out: dict = {"query": query, "entity": token}
        if q is None:
            return out | {"result": None, "note": "there is no such query"}
        plan = planner.query_plan_for(self, q, self._node(token))
        state = planner.run(self, plan, token)
        out |= {"plan": plan, "trace": list(state.trace), "result": state.result}
        if q["objective"] == "attribute":
            return out | {"mode": "direct", "items": state.evidence}
        if q["objective"] != "traverse":
            return out | {"mode": "direct", "items": state.rows}
        found = state.nodes if state.edges is None else state.edges
        mode = "discovered" if state.edges is None else "direct"
        if found is None or found.isEmpty():
            return out | {"mode": "empty", "items": found, "reason": f"no edge or path of {q['relation']} starts at {token}"}
        return out | {"relation": q["relation"], "mode": mode, "items": found if mode == "discovered" else found.select("dir", "other", "evidence")}

    # --- questions in words ------------------------------------------------------------------------------------------

    def node_of(self, token: str) -> str | None:
        """The node of a token that names one exactly."""
        found = identity.resolve(self.entities, token, lambda: self.promoted, loosely=False, index=self.names).one
        return found and found["node_key"]

    def class_of(self, node: str) -> str | None:
        r = self.entities.where(F.col("node_key") == node).select("class").first()
        return r and r["class"]

    def pk_of(self, node: str) -> str | None:
        r = self.entities.where(F.col("node_key") == node).select("pk").first()
        return r and r["pk"]

    def relation_between(self, a: str, b: str) -> tuple[str | None, str]:
        """The first relation between two classes, and its direction seen from the second: 'in' where a's edges lead to b."""
        rows = self.edges.where(((F.col("src_class") == a) & (F.col("dst_class") == b)) | ((F.col("src_class") == b) & (F.col("dst_class") == a)))
        r = rows.groupBy("rel", "src_class").agg(F.min("ord").alias("first")).orderBy("first").first()
        return (None, "in") if r is None else (r["rel"], "in" if r["src_class"] == a else "out")

    def classify_word(self, token: str, named: dict[str, list[dict]] | None = None) -> planner.Meaning:
        """A number, a word of the grammar, of the workbook, an entity (exactly), several entities, or nothing known.

        named are the phrases of a question that are names, as :meth:`TextIndex.phrases` has them. A column's name means
        the column only if no entity is called like it.
        """
        if planner.looks_like_number(token):
            return planner.Meaning("number", token, value=int(token) if token.isdigit() else float(token))
        found = self.vocabulary.candidates(token)
        if found and found[0].type != "attribute":
            c = found[0]
            kind = "concept" if c.owner == "grammar" else "workbook"
            return planner.Meaning(kind, token, c.canonical, c.type, candidates=tuple(found))
        called = (named or {}).get(normal(token))
        if called is None and not found:
            hit = identity.resolve(self.entities, token, lambda: self.promoted, loosely=False, index=self.names)
            called = hit.found
        if called:
            if len(called) == 1:
                return planner.Meaning("entity", token, called[0]["node_key"], called[0]["class"])
            return planner.Meaning("ambiguous", token, candidates=tuple(x["node_key"] for x in called))
        if found:
            return planner.Meaning("attribute", token, found[0].canonical, "attribute", candidates=tuple(found))
        return planner.Meaning("unresolved", token)

    def plan(self, text: str) -> dict:
        """Tokens, meanings, the trees of scopes and tasks, and the plan of a question, before it runs.

        All runs of words are looked up as names at once; the longest that is one is a token.
        """
        longest = max(5, min(self.names.longest, 12))
        named = self.names.phrases(normal(r) for r in language.runs(text, longest))
        tokens = language.tokenize(text, self.vocabulary, longest, lambda run: normal(run) in named)
        meanings = [self.classify_word(t.text, named) for t in tokens]
        # relations are named in passing: they aren't targets
        scope = planner.scopes([m for m in meanings if m.type != "relation"])
        task = planner.resolved(planner.tasks(scope), self)
        words = [m.text for m in meanings if m.kind in ("unresolved", "attribute")]
        operations = list(dict.fromkeys(op for t in task.walk() for op in t.operations))
        return {"query": text, "tokens": tokens, "meanings": meanings, "intent": language.intent_of(tokens, self.vocabulary), "scopes": scope, "execution": task, "operations": operations, "plan": planner.compiled(task), "words": words, "ambiguous": {m.text: list(m.candidates) for m in meanings if m.kind == "ambiguous"}}

    def ask(self, text: str) -> dict:
        """A question about registries or entities: its plan, what ran, and the result."""
        made = self.plan(text)
        state = planner.run(self, made["plan"], made["execution"].target, made["words"])
        return made | {"trace": list(state.trace), "result": state.result, "state": state}

    def query_entity(self, token: str, prefer: str | None = None) -> dict:
        """The first of an entity's pipelines, or one whose name holds the preferred word, and what it is about."""
        found = self.discover(token)
        if found["status"] != "resolved":
            return found
        fits = self.pipelines(token)
        chosen = next((p for p in fits if prefer and prefer.upper() in p["name"]), fits[0] if fits else None)
        return found | {"pipelines": fits, "chosen": chosen, "result": self.relation_view(token)}

    def open_entity(self, token: str | None) -> object:
        """A registry's members in order, or what an entity is."""
        if token is None:
            return None
        if self.wb.sheet(token):
            return self.wb.rows(token).orderBy(workbook.ORD)
        return self.discover(token)

    def suggest(self, token: str, limit: int = 8) -> dict:
        """Next steps from an entity; the candidates of an ambiguous token; for an unknown one search hits or the busiest nodes."""
        r = self.resolve(token)
        if r.one and not r.one["node_key"].startswith("VPROM:"):
            return {"status": "resolved", "items": self.suggest_next(token, limit=limit)}
        if r.found:
            return {"status": "ambiguous", "items": r.found[:limit]}
        hits = self.search(token).limit(limit)
        return {"status": "search", "items": hits} if not hits.isEmpty() else {"status": "unknown", "items": explore.busiest(self.edges, self.entities, limit)}

    def promoted_entity(self, promoted_id: str) -> dict | None:
        return explore.promoted_view(self.wb, self.promoted, promoted_id)

    def pipelines(self, token: str) -> list[dict]:
        return explore.applicable_pipelines(self.wb, self.near, self.entities, self._node(token))

    def reachable(self, token: str, target_class: str) -> DataFrame:
        node, cls = self._known(token)
        return graph.all_reachable_paths(self.adjacency, node, target_class, reach=self.reachability, source_class=cls)

    def request(self, text: str, target: str | None = None, verb: str = "", stage: str | None = None) -> dict:
        """A request by its class: data flow, dependencies, execution stages, rows at a stage, audits, gaps, or a lookup."""
        q = language.request_class(text, verb)
        out: dict = {"query_type": q, "target": target, "result": None}
        node = self.node(target) if target else None
        runs = next((s for s in self.wb.catalog if s.execution and s.name in self.wb.frames), None)
        if q == "Q-07":
            low = text.lower()
            if "dead" in low:
                out["result"] = integrity.find_dead(self.wb)
            elif "orphan" in low or "lifecycle" in low:
                out["result"] = integrity.find_orphan(self.edges, self.entities)
            elif "evidence" in low:
                out["result"] = integrity.find_missing_evidence(self.wb)
            else:
                out["result"] = integrity.check_fk(self.wb, self.entities)
        elif q == "Q-05" and runs and stage:
            out["result"] = relational.filtered(self.wb.rows(runs.name), stage, "✅")
        elif node is None:
            out["note"] = "the target names no single entity"
        elif q == "Q-03":
            out["result"] = graph.neighbors(self.near, node, "out").where(F.col("flow") == "Data")
        elif q == "Q-04" and runs:
            out["result"] = derive.stages(self.wb, runs.name, self.resolve(target).one["pk"], 2)
        elif q == "Q-08":
            out["result"] = self.lifecycle(target).where("NOT filled")
        else:
            out["result"] = graph.neighbors(self.near, node)
        return out

    # --- the whole workbook --------------------------------------------------------------------------------------------

    def invariants(self, threshold: float = 1.0) -> DataFrame:
        return derive.invariants(self.wb, self.entities, self.edges, threshold)

    def property_invariants(self, threshold: float = 1.0) -> DataFrame:
        return derive.property_invariants(self.wb, self.entities, self.edges, threshold)

    def derive_all(self) -> dict[str, DataFrame]:
        """Invariants, the rules that they become, and the queries that these become, by the workbook's own registries if it has them."""
        found = written(self.property_invariants(), "invariants")
        ruled = derive.rules_by_templates(found, derive.rule_templates(self.wb))
        return {"invariants": found, "rules": ruled, "queries": derive.queries_by_families(ruled, derive.query_families(self.wb))}

    def features(self) -> DataFrame:
        return discovery.features(self.wb, self.entities)

    def closure(self) -> DataFrame:
        return discovery.closure(self.features())

    def overview(self) -> str:
        """The workbook's kind, its registries and relations, and its integrity, as text."""
        kinds = self.registry_universe().join(derive.registry_previews(self.entities), "class").orderBy("class").collect()  # a row a sheet
        rels = derive.relation_universe(self.edges).orderBy(F.desc("n"), "rel").collect()  # a row a relation
        lines = [discovery.summary(self.wb), "", *(f"{r['class']}: {r['entities']} ({', '.join(r['preview'])})" for r in kinds), "", *(f"{r['rel']}: {r['n']} ({r['kind']})" for r in rels)]
        return "\n".join([*lines, "", integrity.dashboard(self.checks())])

    def checks(self) -> dict[str, int]:
        return integrity.checks(self.wb, self.entities, self.edges)

    def confidence(self) -> int:
        return integrity.confidence(self.checks())

    def registry_universe(self) -> DataFrame:
        return derive.registry_universe(self.entities, self.edges)

    def capabilities(self) -> DataFrame:
        return derive.capabilities(self.entities, self.edges)

    def export(self, path: str) -> dict[str, int]:
        """Report tables as a ZIP; entities and edges themselves go to Parquet."""
        tables = self.derive_all() | {"cardinality": graph.cardinality(self.edges), "capabilities": self.capabilities(), "registries": self.registry_universe(), "reachability": self.reachability, "features": self.features().withColumn("detected_in", F.array_join("detected_in", ", ")), "nodes": self.entities.drop("metadata", "ord"), "edges": self.edges.drop("ord")}
        return sinks.export_zip(tables, path, {"checks": self.checks(), "classification": discovery.classify(self.wb)})
