"""Named queries over the benchmark tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from noticeflow.workload.domain import Tables, oracle_with

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **extra: str):
    """Register ``fn(tables) -> DataFrame``; ``extra`` are more named sub-queries."""

    def register(fn):
        def run(spark, sf_dir):
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle_with(oracle, *extra.items())
        return fn

    return register
