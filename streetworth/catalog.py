"""All queries of the library, by importing every module that registers some."""

from __future__ import annotations

from streetworth import queries  # noqa: F401
from streetworth.plans import access, areas, audits, context, exchange, extracts, hexes, layers, ledgers, lists, markets, matching, network, rasters, routing, selection, siting, tags, town  # noqa: F401
from streetworth.registry import QUERIES, SQL  # noqa: F401
