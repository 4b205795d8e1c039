"""Relational, identity, graph, integrity and derivation operators over workbooks."""
