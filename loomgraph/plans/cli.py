"""A small command line: python -m loomgraph.plans.cli WORKBOOK [COMMAND ARGUMENT...]; without a command, a prompt."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from loomgraph.storage import scope

from .session import KEPT, Engine

COMMANDS = {
    "search": lambda e, *a: e.search(" ".join(a)),
    "list": lambda e, p: e.list_entities(p),
    "rel": lambda e, t, r: e.explain_relation(t, r)["items"],
    "compare": lambda e, a, b: e.compare(a, b),
    "analyze": lambda e, t: e.analyze(t),
    "actions": lambda e, t: e.menu(t),
    "chain": lambda e, t: e.discovery_chain(t),
    "perspective": lambda e, t: e.perspective(t),
    "discover": lambda e, t, c=None: e.discover(t, c),
    "contexts": lambda e: e.contexts(),
    "summary": lambda e: e.registry_universe(),
    "verify": lambda e: e.checks() | {"confidence": e.confidence()},
    "export": lambda e, p: e.export(p),
    "ask": lambda e, *a: e.ask(" ".join(a))["result"],
}


def handle(engine: Engine, words: list[str], most: int = 80) -> str:
    """One command's result as text; tables show at most so many rows and their true number."""
    if not words:
        return "commands: " + ", ".join(COMMANDS)
    name, *rest = words
    try:
        got = COMMANDS[name](engine, *rest) if name in COMMANDS else COMMANDS["ask"](engine, *words)
    except (KeyError, TypeError) as x:
        return f"{name}: {x}"
    if isinstance(got, DataFrame):
        rows, n = got.limit(most).collect(), got.count()
        return "\n".join([" | ".join(got.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in rows), f"{n} rows"])
    return str(got)


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    engine = Engine.open(spark, argv[0])
    if argv[1:]:
        print(handle(engine, argv[1:]))
        return 0
    for line in sys.stdin:
        if line.strip() in ("quit", "exit"):
            break
        with scope(*KEPT):
            print(handle(engine, line.split()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
