"""All queries over the driver's tables."""

from docketry.plans import answers, chain, danish, evaluation, facets, hybrid, lookups, passages, ranking, records, sources, texts, trials  # noqa: F401
from docketry.plans.registry import ORACLES, QUERIES, query, table  # noqa: F401
