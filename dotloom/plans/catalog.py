"""All registered queries of the counting operators."""

from dotloom.plans import evaluation, files, groups, learning, registry, scoring

_ALL = (registry, scoring, evaluation, groups, files, learning)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _ALL for k, v in m.ORACLE_SQL.items()}
