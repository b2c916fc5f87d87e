"""Queries over the driver's tables, each with its SQL oracle."""

from . import area_queries, geo_queries, line_queries, measure_queries, name_queries, road_queries, rule_queries

_ALL = area_queries.QUERIES | rule_queries.QUERIES | geo_queries.QUERIES | line_queries.QUERIES | measure_queries.QUERIES | name_queries.QUERIES | road_queries.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
