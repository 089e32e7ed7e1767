"""The query catalogue: the feature store's operators over whole tables, with the SQL that states the same.

Only what has no rows to return (freeing, closing, raw addresses) has no query.
"""

from __future__ import annotations

from .plans import collections, layers, measures, numbers, shapes, tiling

_MODULES = (layers, numbers, shapes, tiling, collections, measures)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
flagship = layers.flagship
