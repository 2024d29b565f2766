"""Queries over the benchmark tables."""

import importlib

_MODULES = ("scalar_queries", "crawl_queries", "notice_queries", "catalog_queries", "coverage_queries", "audit_queries")


def all_queries():
    """(queries, oracle texts) of every workload module."""
    from noticeflow.workload import registry

    for name in _MODULES:
        importlib.import_module(f"noticeflow.workload.{name}")
    return registry.QUERIES, registry.ORACLES
