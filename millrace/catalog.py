"""All queries of the engine by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from .queries import core, corpus, programs, structure

_PARTS = (core.R, corpus.R, structure.R, programs.R)
QUERIES = {name: query for part in _PARTS for name, query in part.queries.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.sql.items()}
