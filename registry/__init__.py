"""All registered queries and the SQL they are checked against."""

from registry import corpus, evaluate, risk, rules, stores, text, vectors

_PARTS = (text, corpus, rules, vectors, evaluate, risk, stores)

QUERIES = {key: query for part in _PARTS for key, query in part.QUERIES.items()}
ORACLES = {key: sql for part in _PARTS for key, sql in part.ORACLES.items()}
