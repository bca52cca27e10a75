"""Registered queries and the SQL that checks them."""

from . import batch_queries, card_queries, mart_queries, parser_queries, search_queries, source_queries

MODULES = (mart_queries, search_queries, batch_queries, card_queries, parser_queries, source_queries)
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
