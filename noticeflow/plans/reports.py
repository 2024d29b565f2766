"""Report jobs: coverage and alert matching, each over one written intermediate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from noticeflow.operators import alerts, coverage
from noticeflow.session import materialize


def coverage_report(
    catalog: DataFrame, catalog_sources: DataFrame, institutions: DataFrame, sources: DataFrame, now: Column, **filters
) -> dict[str, DataFrame]:
    """Every part of the coverage report as its own frame.

    Keys are judged on the whole catalog, rows are claimed within the filtered one.
    """
    scoped = coverage.filter_catalog(catalog, catalog_sources, **filters)
    links = coverage.link_registry(scoped, institutions, catalog)
    records = materialize(
        coverage.coverage_records(scoped, catalog_sources, links, institutions, sources, now), "records"
    )
    mine = catalog_sources.join(records.select("official_code"), "official_code", "left_semi")
    return {
        "totals": coverage.coverage_totals(records),
        "funnel": coverage.coverage_funnel(records),
        "breakdown": coverage.coverage_breakdown(records),
        "spiders": coverage.spider_breakdown(records, mine),
        "statuses": coverage.status_counts(records, mine),
        "pending": coverage.pending_list(records),
        "last_audit": coverage.last_audit(mine),
    }


def match_run(alert_rows: DataFrame, notices: DataFrame, outbox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new outbox rows, one-row counters) of a match run."""
    hits = materialize(alerts.alert_hits(alert_rows, notices), "hits")
    created = materialize(alerts.new_notifications(alerts.matched_pairs(alert_rows, hits), outbox), "outbox")
    return created, alerts.match_stats(alert_rows, hits, created)
