"""Which extractor handles a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticeflow.functions.urls import split_url


def route_sources(sources: DataFrame) -> DataFrame:
    """Add ``extractor``; portals of the government family use the paginated one."""
    kind = F.upper(F.coalesce("source_type", F.lit("")))
    parts = split_url(F.col("url"))
    host, path = F.lower(parts.netloc), F.lower(parts.path)
    # Source types and host fragments, in priority order.
    extractor = (
        F.when(
            kind.isin("SIGAA", "SIGAA_JSF")
            | (host.contains("sigaa") & path.contains("processo_seletivo")),
            "sigaa",
        )
        .when(kind.isin("WORDPRESS", "WORDPRESS_ARCHIVE"), "wordpress")
        .when(kind.isin("GOVBR", "PLONE", "GOVBR_COLLECTION") | host.contains("gov.br"), "pagination")
        .when(
            kind.isin("PAGINATED_HTML", "HTML_PAGINATED", "TABLE_HTML", "PROCESS_SELECTION_PORTAL"),
            "pagination",
        )
        .when(host.contains("wp-content") | host.contains("wordpress"), "wordpress")
        .otherwise("generic")
    )
    return sources.withColumn("extractor", extractor)
