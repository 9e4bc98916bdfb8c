"""All registered queries of the price-intelligence operators."""

from __future__ import annotations

from pricelore.plans import activity, browse, catalog, categories, duplicates, ingestion, matching, offers, pages, prices, rails, reports, scheduling, semistructured, streams, text

QUERIES = {k: v for m in (prices, rails, activity, browse, catalog, categories, duplicates, ingestion, matching, offers, pages, semistructured, scheduling, reports, text, streams) for k, v in m.registry.queries.items()}
ORACLES = {k: v for m in (prices, rails, activity, browse, catalog, categories, duplicates, ingestion, matching, offers, pages, semistructured, scheduling, reports, text, streams) for k, v in m.registry.oracles.items()}
