"""Queries over the given tables, each with its SQL counterpart where SQL can say it."""

from registry import graph_queries, java_queries, layout_queries, resolve_queries, sync_queries, text_queries

MODULES = [graph_queries, layout_queries, text_queries, resolve_queries, sync_queries, java_queries]


def all_queries():
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
