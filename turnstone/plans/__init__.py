"""Named queries over the given tables."""

from . import catalog, features, retrieval, sources, texts, traces  # noqa: F401
from . import monitoring  # noqa: F401  (uses the SQL of traces)

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE
