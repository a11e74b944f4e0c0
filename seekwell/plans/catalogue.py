"""The query catalogue: one entry per operator, with DuckDB SQL beside each."""

from seekwell.plans import graphs, pages, relational, search, service, streams, words  # noqa: F401  they register their queries
from seekwell.plans.registry import ORACLES, QUERIES  # noqa: F401
