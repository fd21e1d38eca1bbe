"""Registered queries and their SQL twins."""

from rainweave.plans import attention, graph, links, radar, sampling, scores, series, spatial, stations, streams  # noqa: F401  (each registers its queries)
from rainweave.plans.registry import QUERIES, SQL  # noqa: F401
