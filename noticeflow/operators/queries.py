"""Notice and registry queries: filters, conditional joins, order, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Columns a notice reader never sees.
INTERNAL_COLUMNS = ("normalized_title", "normalized_url", "content_hash", "fingerprint", "is_active")


def page(df: DataFrame, order: list, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Sorted page; offset and limit plan as one top-k, not as a full sort."""
    out = df.orderBy(*order).offset(skip) if skip else df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def search_notices(
    notices: DataFrame,
    institutions: DataFrame | None = None,
    *,
    keyword=None,
    institution_id=None,
    state=None,
    notice_type=None,
    detected_after=None,
    detected_before=None,
    skip: int = 0,
    limit: int | None = 50,
) -> DataFrame:
    """Active notices, newest first.  ``%`` and ``_`` in the keyword act as wildcards."""
    df = notices.filter("is_active")
    if institution_id is not None:
        df = df.filter(F.col("institution_id") == institution_id)
    if notice_type:
        df = df.filter(F.col("notice_type") == notice_type)
    if detected_after is not None:
        df = df.filter(F.col("detected_at") >= F.lit(detected_after))
    if detected_before is not None:
        df = df.filter(F.col("detected_at") <= F.lit(detected_before))
    if keyword:
        pattern = f"%{keyword}%"
        df = df.filter(F.col("title").ilike(pattern) | F.col("description").ilike(pattern))
    if state:
        inside = institutions.filter(F.col("state") == state).select(F.col("id").alias("institution_id"))
        df = df.join(inside, "institution_id", "left_semi")
    return page(df, [F.desc("detected_at"), "id"], skip, limit)


def notice_detail(notices: DataFrame, institutions: DataFrame, notice_id) -> DataFrame:
    """One active notice with its institution; ``notice_id`` is a value or a frame of ids."""
    active = notices.filter("is_active")
    if isinstance(notice_id, DataFrame):
        active = active.join(notice_id.select("id"), "id", "left_semi")
    else:
        active = active.filter(F.col("id") == notice_id)
    public = active.drop(*INTERNAL_COLUMNS)
    owner = institutions.select(
        F.col("id").alias("institution_id"),
        F.col("name").alias("institution_name"),
        F.col("initials").alias("institution_initials"),
        F.col("state").alias("institution_state"),
    )
    return public.join(owner, "institution_id", "left")


def _registry_filters(df: DataFrame, filters: dict) -> DataFrame:
    columns = {
        "region": "region",
        "state": "state",
        "administrative_category_code": "administrative_category_code",
        "academic_organization_code": "academic_organization_code",
        "eligibility_status": "eligibility_status",
        "coverage_status": "source_discovery_status",
    }
    for name, column in columns.items():
        value = filters.get(name)
        if value is not None and value != "":
            value = value.upper() if name == "state" else value
            df = df.filter(F.col(column) == F.lit(value))
    return df


def _needs_review(*statuses: Column, eligibility: Column) -> Column:
    test = F.coalesce(eligibility, F.lit("")).contains("manual_review")
    for status in statuses:
        test = test | status.eqNullSafe("manual_review")
    return test


def list_institutions(
    institutions: DataFrame,
    sources: DataFrame | None = None,
    *,
    is_active=None,
    has_source=None,
    manual_review=None,
    skip: int = 0,
    limit: int | None = 100,
    **filters,
) -> DataFrame:
    df = _registry_filters(institutions, filters)
    if is_active is not None:
        df = df.filter(F.col("is_active") == F.lit(is_active))
    if manual_review is not None:
        review = _needs_review(
            F.col("source_discovery_status"),
            eligibility=F.col("eligibility_status"),
        )
        df = df.filter(review if manual_review else ~review)
    if has_source is not None:
        owners = sources.select(F.col("institution_id").alias("id")).distinct()
        df = df.join(owners, "id", "left_semi" if has_source else "left_anti")
    return page(df, ["id"], skip, limit)


def list_sources(
    sources: DataFrame,
    institutions: DataFrame,
    *,
    institution_id=None,
    verification_status=None,
    institution_active=None,
    source_active=None,
    manual_review=None,
    skip: int = 0,
    limit: int | None = 100,
    **filters,
) -> DataFrame:
    """Sources by their own and their institution's fields; joins only when asked to."""
    df = sources
    if institution_id is not None:
        df = df.filter(F.col("institution_id") == institution_id)
    if verification_status:
        df = df.filter(F.col("coverage_status") == verification_status)
    if source_active is not None:
        df = df.filter(F.col("is_active") == F.lit(source_active))
    joins = any(v is not None for v in (institution_active, manual_review, *filters.values()))
    if joins:
        owners = _registry_filters(institutions, filters)
        if institution_active is not None:
            owners = owners.filter(F.col("is_active") == F.lit(institution_active))
        owners = owners.select(
            F.col("id").alias("institution_id"),
            F.col("source_discovery_status").alias("_discovery"),
            F.col("eligibility_status").alias("_eligibility"),
        )
        df = df.join(owners, "institution_id")
        if manual_review is not None:
            review = _needs_review(
                F.col("coverage_status"),
                F.col("_discovery"),
                eligibility=F.col("_eligibility"),
            )
            df = df.filter(review if manual_review else ~review)
        df = df.drop("_discovery", "_eligibility")
    return page(df, ["id"], skip, limit)


def user_alerts(alerts: DataFrame, user_id, skip: int = 0, limit: int | None = 50) -> DataFrame:
    return page(alerts.filter(F.col("user_id") == user_id), ["id"], skip, limit)


def user_notifications(notifications: DataFrame, user_id, skip: int = 0, limit: int | None = 50) -> DataFrame:
    return page(notifications.filter(F.col("user_id") == user_id), ["id"], skip, limit)


def notification_detail(notifications: DataFrame, notices: DataFrame, user_id, notification_id) -> DataFrame:
    """A notification of this user with its notice; nothing for anybody else's."""
    own = notifications.filter((F.col("id") == notification_id) & (F.col("user_id") == user_id))
    facts = notices.select(F.col("id").alias("notice_id"), "title", "url", "notice_type")
    return own.join(facts, "notice_id", "left")


def scoped_sources(sources: DataFrame, institutions: DataFrame, initials) -> DataFrame:
    """Active sources of active institutions with the given initials, in audit order."""
    owners = institutions.filter(F.col("is_active") & F.col("initials").isin(list(initials))).select(
        F.col("id").alias("institution_id"), F.col("initials").alias("institution_initials")
    )
    joined = sources.filter("is_active").join(owners, "institution_id")
    return joined.orderBy("institution_initials", "name", "id")
