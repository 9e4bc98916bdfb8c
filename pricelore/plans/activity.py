"""Queries of activity, trends and demand, with their SQL."""

from __future__ import annotations

from pricelore.operators import activity as op
from pricelore.plans.base import Registry
from pricelore.sources.views import EVENTS_AS_OF, Domain

registry = Registry()
query = registry.query

HOURS = """hours AS (SELECT product_id, event_type, date_trunc('hour', ts) AS hour, count(DISTINCT client_id) + sum(CASE WHEN client_id IS NULL THEN 1 ELSE 0 END) AS n
  FROM activity GROUP BY product_id, event_type, date_trunc('hour', ts))"""
NOW = f"TIMESTAMP '{EVENTS_AS_OF}'"


@query(f", {HOURS} SELECT product_id, event_type, hour, CAST(n AS BIGINT) AS n FROM hours")
def c22_hourly_activity(d: Domain):
    return op.hourly(d.activity)


@query(f""", {HOURS}, sums AS (SELECT product_id, CAST(coalesce(sum(CASE WHEN hour >= {NOW} - INTERVAL 48 HOUR AND hour < {NOW} THEN n END), 0) AS BIGINT) AS recent,
  CAST(coalesce(sum(CASE WHEN hour >= {NOW} - INTERVAL 96 HOUR AND hour < {NOW} - INTERVAL 48 HOUR THEN n END), 0) AS BIGINT) AS baseline FROM hours GROUP BY product_id)
SELECT *, round(recent / CAST(greatest(baseline, 1) AS DOUBLE), 4) AS momentum FROM sums WHERE recent >= 3 AND (baseline = 0 OR recent > baseline)""")
def c20_trending(d: Domain):
    return op.trending(op.hourly(d.activity), EVENTS_AS_OF)


@query(f", {HOURS} SELECT product_id, CAST(sum(n) AS BIGINT) AS n FROM hours WHERE hour >= {NOW} - INTERVAL 168 HOUR AND hour < {NOW} GROUP BY product_id HAVING sum(n) >= 5")
def c21_popular(d: Domain):
    return op.popular(op.hourly(d.activity), EVENTS_AS_OF)


@query(f"""SELECT query, count(*) AS hits, count(DISTINCT session) AS actors FROM searches WHERE ts >= {NOW} - INTERVAL 336 HOUR AND ts < {NOW} AND results > 0
AND length(trim(query)) BETWEEN 2 AND 80 AND NOT regexp_matches(lower(query), '(password|otp|token|ssn|aadhaar)') GROUP BY query HAVING count(*) >= 5 AND count(DISTINCT session) >= 3""")
def c23_popular_queries(d: Domain):
    return op.popular_queries(d.searches, EVENTS_AS_OF)


@query(f""", sums AS (SELECT query, CAST(sum(CASE WHEN ts >= {NOW} - INTERVAL 24 HOUR AND ts < {NOW} THEN 1 ELSE 0 END) AS BIGINT) AS n_24h,
  CAST(sum(CASE WHEN ts >= {NOW} - INTERVAL 168 HOUR AND ts < {NOW} THEN 1 ELSE 0 END) AS BIGINT) AS n_7d, count(DISTINCT CASE WHEN ts >= {NOW} - INTERVAL 24 HOUR AND ts < {NOW} THEN session END) AS users_24h,
  last(results ORDER BY ts, search_id) AS last_results, max(ts) AS last_seen FROM searches GROUP BY query),
scored AS (SELECT *, CASE WHEN last_results = 0 THEN 'missing' ELSE 'covered' END AS coverage,
  CAST(least(100, 40 + CASE WHEN last_results = 0 THEN 20 ELSE 0 END + least(30, n_24h) + least(20, users_24h)) AS DOUBLE) AS score FROM sums)
SELECT *, last_results = 0 AND score >= 70 AS promotable FROM scored""")
def c24_demand(d: Domain):
    return op.demand(d.searches, EVENTS_AS_OF)
