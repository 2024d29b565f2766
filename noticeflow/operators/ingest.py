"""Ingest: choose sources, normalise items, drop the known, log the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeflow.functions import text, urls
from noticeflow.functions.staging import stage
from noticeflow.operators.links import first_per_key


def crawl_targets(sources: DataFrame, institutions: DataFrame, ids=None) -> DataFrame:
    """Active sources of active institutions, optionally only the given ids."""
    chosen = sources.filter("is_active")
    if isinstance(ids, DataFrame):
        chosen = chosen.join(ids.select("id"), "id", "left_semi")
    elif ids is not None:
        chosen = chosen.filter(F.col("id").isin(list(ids)))
    owners = institutions.filter("is_active").select(F.col("id").alias("institution_id"))
    return chosen.join(owners, "institution_id", "left_semi")


def normalize_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Normal title and URLs, fingerprint and type; rows with an empty part are dropped.

    Items: source_id, pos, title, url, dedupe_url, notice_type, description,
    publication_date.  Sources: id, institution_id, url.
    """
    owner = sources.select(
        F.col("id").alias("source_id"), "institution_id", F.col("url").alias("_base")
    )
    wanted = ["source_id", "pos", "title", "url", "dedupe_url", "notice_type", "description", "publication_date"]
    present = [
        F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in wanted
    ]
    joined = items.select(*present).join(owner, "source_id")
    key_url = F.coalesce(F.nullif("dedupe_url", F.lit("")), F.col("url"))
    # Both addresses go through one expression, so the plan carries it once.
    both = F.transform(F.array(F.col("url"), key_url), lambda u: urls.canonical_url(u, F.col("_base")))
    staged = stage(
        stage(joined, normalized_title=text.normalize_title(F.col("title")), _urls=both),
        display_url=F.get("_urls", F.lit(0)),
        normalized_url=F.get("_urls", F.lit(1)),
    )
    kept = staged.filter("normalized_title <> '' and display_url <> '' and normalized_url <> ''")
    return kept.select(
        "source_id",
        "pos",
        "institution_id",
        F.regexp_replace("title", f"^{text.WHITESPACE}|{text.WHITESPACE}$", "").alias("title"),
        "normalized_title",
        F.col("display_url").alias("url"),
        "normalized_url",
        text.normalize_notice_type(F.col("notice_type")).alias("notice_type"),
        "description",
        "publication_date",
        urls.fingerprint(
            F.col("institution_id"), F.col("normalized_title"), F.col("normalized_url")
        ).alias("fingerprint"),
    )


def drop_failed(items: DataFrame, page_status: DataFrame) -> DataFrame:
    """Items of sources without an error: what a failed source gave is rolled back."""
    failed = page_status.filter("error_message is not null").select("source_id").distinct()
    return items.join(failed, "source_id", "left_anti")


def new_notices(normalized: DataFrame, history: DataFrame) -> DataFrame:
    """Items neither known by fingerprint nor by (institution, URL); first item wins.

    Two equi anti joins instead of one OR condition.  Every side of every join is unique
    on its key before it meets the other, so no hot URL, source or copied history row can
    pile up in one task; ranking prunes per map task before its shuffle.
    """
    order = ["source_id", "pos"]
    distinct_items = first_per_key(normalized, ["fingerprint"], order)
    known_prints = history.select("fingerprint").filter("fingerprint is not null").distinct()
    unseen = distinct_items.join(known_prints, "fingerprint", "left_anti")
    per_url = first_per_key(unseen, ["institution_id", "normalized_url"], order)
    known_urls = history.select("institution_id", "normalized_url").distinct()
    return per_url.join(known_urls, ["institution_id", "normalized_url"], "left_anti")


def append_notices(new: DataFrame, now: Column) -> DataFrame:
    """Rows as appended: active, detected now; the unique fingerprint is the id."""
    return new.select(
        F.col("fingerprint").alias("id"),
        "institution_id", "source_id", "title", "normalized_title", "url", "normalized_url",
        "notice_type", "publication_date", now.alias("detected_at"), "description",
        "fingerprint", F.lit(True).alias("is_active"),
    )


def run_log(
    targets: DataFrame, page_status: DataFrame, items: DataFrame, new: DataFrame, now: Column
) -> DataFrame:
    """One row per target: completed with counts, or failed with the error and zeros.

    ``page_status``: source_id, error_message (null for success).
    """
    found = items.groupBy("source_id").agg(F.count("*").alias("found"))
    added = new.groupBy("source_id").agg(F.count("*").alias("added"))
    errors = page_status.groupBy("source_id").agg(F.min("error_message").alias("error_message"))
    joined = (
        targets.select(F.col("id").alias("source_id"))
        .join(errors, "source_id", "left")
        .join(found, "source_id", "left")
        .join(added, "source_id", "left")
    )
    failed = F.col("error_message").isNotNull()
    count = lambda c: F.when(failed, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    return joined.select(
        "source_id",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        count(F.col("found")).alias("items_found"),
        count(F.col("added")).alias("new_items"),
        "error_message",
        now.alias("started_at"),
        now.alias("finished_at"),
    )


def update_source_state(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Carry the newest run into the source rows; untouched sources stay as they are."""
    newest = runs.groupBy("source_id").agg(
        F.max(F.struct("started_at", "finished_at", "status", "error_message")).alias("run")
    )
    joined = sources.join(newest, F.col("id") == F.col("source_id"), "left").drop("source_id")
    ran, ok = F.col("run").isNotNull(), F.col("run.status") == "completed"
    return joined.withColumns({
        "last_checked_at": F.when(ran, F.col("run.finished_at")).otherwise(F.col("last_checked_at")),
        "last_success_at": F.when(ok, F.col("run.finished_at")).otherwise(F.col("last_success_at")),
        "last_error_message": F.when(ok, F.lit(None))
        .when(ran, F.col("run.error_message"))
        .otherwise(F.col("last_error_message")),
    }).drop("run")


def run_summary(runs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return runs.agg(
        F.count("*").alias("sources_checked"),
        F.coalesce(F.sum("items_found"), zero).alias("items_found"),
        F.coalesce(F.sum("new_items"), zero).alias("new_items"),
        F.count_if(F.col("status") == "failed").alias("failed_sources"),
    )
