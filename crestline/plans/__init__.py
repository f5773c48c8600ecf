"""Queries by name, and the SQL that returns the same rows."""

from . import exchange, network, rasters, routing, tracks

PARTS = (tracks, rasters, network, exchange, routing)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in PARTS for name, text in part.SQL.items()}
