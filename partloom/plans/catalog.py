"""All registered queries of the engine and the DuckDB SQL each must agree with."""

from __future__ import annotations

from partloom.plans import graph_queries, record_queries, segmenter_queries, shape_queries, text_queries

ALL = [*shape_queries.QUERIES, *text_queries.QUERIES, *graph_queries.QUERIES, *record_queries.QUERIES, *segmenter_queries.QUERIES]


def queries() -> dict:
    return {name: run for name, run, _ in ALL}


def oracle_sql() -> dict:
    return {name: sql for name, _, sql in ALL if sql}
