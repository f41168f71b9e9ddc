"""All queries of the library on street networks, by name."""

from __future__ import annotations

from . import queries_network, queries_places, queries_streets

QUERIES = {**queries_streets.QUERIES, **queries_places.QUERIES, **queries_network.QUERIES}
ORACLES = {**queries_streets.ORACLES, **queries_places.ORACLES, **queries_network.ORACLES}
