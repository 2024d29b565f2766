"""Coverage analytics: link the catalog to the registry, flag, aggregate.

The catalog is two tables: institutions (one row per official_code, catalog_order) and
their sources (official_code, status, recommended_spider, capture_validated_at,
last_verified_at).  Sources are never gathered into one row per institution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeflow.functions.staging import stage
from noticeflow.functions.text import squash, squash_fold
from noticeflow.functions.values import percent
from noticeflow.operators.links import first_per_key
from noticeflow.operators.queries import page
from noticeflow.session import materialize

UNLABELLED = "Não informado"  # fixed value


def filter_catalog(
    catalog: DataFrame,
    catalog_sources: DataFrame,
    *,
    region=None,
    state=None,
    administrative_category_code=None,
    academic_organization_code=None,
    eligibility_status=None,
    coverage_status=None,
    verification_status=None,
    source_status=None,
) -> DataFrame:
    """Filters ignoring case and spacing; a code that is no integer never matches."""
    norm = lambda v: " ".join(v.split()).casefold()
    df = catalog
    for column, value in (
        ("region", region), ("state", state),
        ("eligibility_status", eligibility_status), ("coverage_status", coverage_status),
    ):
        if value:
            df = df.filter(squash_fold(F.col(column)) == norm(value))
    for column, value in (
        ("administrative_category_code", administrative_category_code),
        ("academic_organization_code", academic_organization_code),
    ):
        if value is not None:
            df = df.filter(F.col(column).try_cast("int") == value)
    having = lambda v: catalog_sources.filter(
        squash_fold(F.col("status")) == norm(v)
    ).select("official_code").distinct()
    if verification_status:
        df = df.join(having(verification_status), "official_code", "left_semi")
    if source_status:
        own = squash_fold(F.col("coverage_status")) == norm(source_status)
        marked = having(source_status).withColumn("_has", F.lit(True))
        df = df.join(marked, "official_code", "left").filter(own | F.col("_has").isNotNull()).drop("_has")
    return df


def _keys(df: DataFrame, name: str) -> DataFrame:
    return stage(
        df,
        _c=squash(F.col("official_code").cast("string")),
        _i=squash_fold(F.col("initials")),
        _s=squash_fold(F.col("state")),
        _n=squash_fold(F.col(name)),
    )


_FALLBACKS = (
    ("_identity", ["_i", "_s", "_n"], "_i <> '' and _n <> ''"),
    ("_initials", ["_i", "_s"], "_i <> ''"),
    ("_names", ["_n", "_s"], "_n <> ''"),
)


def link_registry(catalog: DataFrame, institutions: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """(official_code, registry_id) of every catalog row that claims a registry row.

    Code first, then a key that is unique both in the whole catalog (``universe``) and
    among registry rows without a code: identity, initials+state, name+state.  The first
    claimant in catalog order (``catalog_order``) gets the row; a later one gets nothing.
    """
    # Narrow key tables that every tier reads: computed once, written.
    cut = ["_c", "_i", "_s", "_n"]
    rows = _keys(catalog, "official_name")
    every = materialize(_keys(universe if universe is not None else catalog, "official_name").select(*cut), "catalog-keys")
    registry = materialize(_keys(institutions, "name").select("id", *cut), "registry-keys")
    # Several rows with one code: the last one read wins; the largest id stands for it.
    by_code = registry.filter("_c <> ''").groupBy("_c").agg(F.max("id").alias("_code"))
    codeless = registry.filter("_c = ''")
    # A row without a key gets a private one, so that blanks do not meet in one task.
    alone = lambda valid: F.when(F.expr(valid), "").otherwise(F.col("catalog_order").cast("string"))
    spread_join = lambda left, right, keys, valid: left.withColumn("_k", alone(valid)).join(
        right.withColumn("_k", F.lit("")), [*keys, "_k"], "left"
    ).drop("_k")
    narrow = rows.select("official_code", "catalog_order", "_c", "_i", "_s", "_n")
    linked = spread_join(narrow, by_code, ["_c"], "_c <> ''")
    for name, keys, valid in _FALLBACKS:
        singles = every.filter(valid).groupBy(*keys).agg(F.count("*").alias("_a")).filter("_a = 1")
        found = codeless.filter(valid).groupBy(*keys).agg(
            F.count("*").alias("_b"), F.min("id").alias(name)
        ).filter("_b = 1")
        linked = spread_join(linked, found.join(singles, keys).select(*keys, name), keys, valid)
    claims = linked.select(
        "official_code", "catalog_order",
        F.coalesce("_code", "_identity", "_initials", "_names").alias("registry_id"),
    ).filter("registry_id is not null")
    return first_per_key(claims, ["registry_id"], ["catalog_order"]).select("official_code", "registry_id")


def is_recent(now: Column) -> Column:
    """Active and last successful within twice its cadence, at least one day."""
    minutes = F.coalesce(F.nullif("check_frequency_minutes", F.lit(0)), F.lit(1440)).cast("long")
    allowed = F.greatest(F.greatest(minutes, F.lit(1)) * 2, F.lit(1440))
    age = F.unix_micros(now) - F.unix_micros("last_success_at")
    return F.coalesce(F.col("is_active") & (age <= allowed * 60_000_000), F.lit(False))


def coverage_records(
    catalog: DataFrame, catalog_sources: DataFrame, links: DataFrame, institutions: DataFrame, sources: DataFrame, now: Column
) -> DataFrame:
    """Catalog rows with their coverage flags, source count and distinct source statuses."""
    false = F.lit(False)
    status = F.nullif(squash_fold(F.col("status")), F.lit(""))
    mapped = catalog_sources.groupBy("official_code").agg(
        F.count("*").alias("mapped_sources"),
        F.bool_or(status == "verified").alias("_verified"),
        F.bool_or(F.coalesce("capture_validated_at", F.lit("")) != "").alias("_captured_catalog"),
        F.sort_array(F.collect_set(status)).alias("source_statuses"),  # as many as there are statuses
    )
    per_owner = sources.groupBy(F.col("institution_id").alias("registry_id")).agg(
        F.bool_or(F.coalesce("is_active", false)).alias("_source_active"),
        F.bool_or(is_recent(now)).alias("_recent"),
        F.bool_or(F.col("capture_validated_at").isNotNull()).alias("_captured"),
    )
    owners = institutions.select(F.col("id").alias("registry_id"), F.col("is_active").alias("_inst_active"))
    linked = links.join(owners, "registry_id").join(per_owner, "registry_id", "left")
    joined = catalog.join(linked, "official_code", "left").join(mapped, "official_code", "left")
    return joined.withColumns({
        "eligible": squash_fold(F.col("eligibility_status")).startswith("included"),
        "registered": F.col("registry_id").isNotNull(),
        "mapped": F.col("mapped_sources").isNotNull(),
        "mapped_sources": F.coalesce("mapped_sources", F.lit(0)),
        "source_statuses": F.coalesce("source_statuses", F.array().cast("array<string>")),
        "verified": F.coalesce("_verified", false),
        "capture_validated": F.coalesce("_captured_catalog", false) | F.coalesce("_captured", false),
        "active_monitoring": F.coalesce("_recent", false),
        "source_active": F.coalesce("_source_active", false),
        "institution_active": F.when(F.col("registry_id").isNotNull(), F.coalesce("_inst_active", false)),
    }).drop("_source_active", "_recent", "_captured", "_inst_active", "_verified", "_captured_catalog")


STAGES = ("registered", "mapped", "verified", "capture_validated", "active_monitoring")


def coverage_funnel(records: DataFrame) -> DataFrame:
    """stage, institutions, percent of eligible: one aggregate, unpivoted."""
    counts = records.filter("eligible").agg(
        F.count("*").alias("_total"), *[F.count_if(F.col(s)).alias(s) for s in STAGES]
    )
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("institutions")) for s in STAGES])
    flat = counts.select("_total", F.inline(rows))
    return flat.select("stage", "institutions", percent(F.col("institutions"), F.col("_total")).alias("percent"))


def _status(column: str = "coverage_status", default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(squash(F.col(column)), F.lit("")), F.lit(default))


def coverage_totals(records: DataFrame) -> DataFrame:
    ok, census = F.col("eligible"), ~F.col("official_code_origin").eqNullSafe("post_census_law")
    n = lambda name, test: F.count_if(test).alias(name)
    return records.agg(
        F.count("*").alias("inventory_total"),
        n("census_raw_total", census),
        n("eligible_census_total", census & ok),
        n("post_census_total", ~census),
        n("eligible_total", ok),
        F.coalesce(F.sum("mapped_sources"), F.lit(0)).alias("mapped_sources_inventory"),
        F.coalesce(F.sum(F.when(ok, F.col("mapped_sources"))), F.lit(0)).alias("mapped_sources_eligible"),
        n("with_source", ok & F.col("mapped")),
        n("without_source", ok & ~F.col("mapped")),
        n("verified", ok & F.col("verified")),
        *[n(s, ok & (_status() == s)) for s in ("partial", "manual_review", "source_not_found")],
        n("captured", ok & F.col("capture_validated")),
        n("active", ok & F.col("active_monitoring")),
    )


DIMENSIONS = {
    "region": ("region", None),
    "state": ("state", None),
    "category": ("administrative_category_code", "administrative_category"),
    "organization": ("academic_organization_code", "academic_organization"),
}


def coverage_breakdown(records: DataFrame, dims: dict = DIMENSIONS) -> DataFrame:
    """Eleven measures per (dimension, key); the first label in catalog order names a key.

    Dimensions are unpivoted into rows, so one partial aggregate serves them all.
    """

    def member(name: str, key: str, label: str | None) -> Column:
        k = F.coalesce(F.nullif(squash(F.col(key).cast("string")), F.lit("")), F.lit("unknown"))
        shown = F.coalesce(F.nullif(squash(F.col(label)), F.lit("")), F.lit(UNLABELLED)) if label else k
        return F.struct(F.lit(name).alias("dimension"), k.alias("key"), shown.alias("_label"))

    measures = ["eligible", "mapped_sources", "mapped", "verified", "capture_validated", "active_monitoring"]
    rows = records.select(
        *measures, "catalog_order", squash_fold(F.col("coverage_status")).alias("_status"),
        F.inline(F.array(*[member(n, k, l) for n, (k, l) in dims.items()])),
    )
    ok = F.col("eligible")
    n = lambda name, test: F.count_if(ok & test).alias(name)
    return rows.groupBy("dimension", "key").agg(
        F.min_by("_label", "catalog_order").alias("label"),
        F.count("*").alias("inventory_total"),
        F.count_if(ok).alias("eligible_total"),
        F.coalesce(F.sum(F.when(ok, F.col("mapped_sources"))), F.lit(0)).alias("mapped_sources"),
        n("institutions_with_source", F.col("mapped")),
        n("institutions_without_source", ~F.col("mapped")),
        n("verified", F.col("verified")),
        *[n(s, F.col("_status") == s) for s in ("partial", "manual_review", "source_not_found")],
        n("capture_validated", F.col("capture_validated")),
        n("active_monitoring", F.col("active_monitoring")),
    )


def _eligible_sources(records: DataFrame, catalog_sources: DataFrame) -> DataFrame:
    return catalog_sources.join(records.filter("eligible").select("official_code"), "official_code", "left_semi")


def spider_breakdown(records: DataFrame, catalog_sources: DataFrame) -> DataFrame:
    flat = _eligible_sources(records, catalog_sources).withColumn("spider", _status("recommended_spider"))
    # Two-level aggregate: a spider that owns most sources still spreads by institution.
    per = flat.groupBy("spider", "official_code").agg(F.count("*").alias("n"))
    return per.groupBy("spider").agg(F.sum("n").alias("sources"), F.count("*").alias("institutions"))


def status_counts(records: DataFrame, catalog_sources: DataFrame) -> DataFrame:
    """grain (institution or source), status, n."""
    inst = records.filter("eligible").select(F.lit("institution").alias("grain"), _status().alias("status"))
    src = _eligible_sources(records, catalog_sources).select(F.lit("source").alias("grain"), _status("status").alias("status"))
    return inst.unionByName(src).groupBy("grain", "status").agg(F.count("*").alias("n"))


def pending_list(records: DataFrame) -> DataFrame:
    """Eligible rows that are not fully verified, with the reason, in report order."""
    status = _status(default="manual_review")
    # Default reasons.
    reason = F.coalesce(
        F.nullif(squash(F.col("coverage_notes")), F.lit("")),
        F.when(~F.col("mapped"), "Nenhuma fonte oficial mapeada.").otherwise(
            "A fonte mapeada ainda não possui verificação integral."
        ),
    )
    pending = records.filter(F.col("eligible") & ~((status == "verified") & F.col("verified")))
    return pending.select(
        *[squash(F.col(c)).alias(c) for c in ("official_code", "official_name", "state", "region")],
        status.alias("status"),
        reason.alias("reason"),
    ).orderBy("region", "state", "official_name", "official_code")


def last_audit(catalog_sources: DataFrame, metadata: dict | None = None) -> DataFrame:
    """Latest ISO date of any source check or audit entry of the metadata."""
    given = [
        str(v) for k, v in (metadata or {}).items()
        if any(word in " ".join(k.split()).casefold() for word in ("audit", "verified"))
    ]
    iso = lambda c: F.when(squash(c).rlike("^.{4}-.{2}-.{2}"), F.substring(squash(c), 1, 10))
    seen = catalog_sources.agg(F.max(iso(F.col("last_verified_at"))).alias("d"))
    for value in given:
        seen = seen.select(F.greatest("d", iso(F.lit(value))).alias("d"))
    return seen.select(F.col("d").alias("last_audit"))


def coverage_institutions(
    records: DataFrame,
    *,
    has_source=None,
    source_active=None,
    institution_active=None,
    manual_review=None,
    skip: int = 0,
    limit: int | None = 100,
) -> tuple[DataFrame, DataFrame]:
    """(one-row total, ordered page) of records under tri-state filters."""
    review = (
        (squash_fold(F.col("coverage_status")) == "manual_review")
        | squash_fold(F.col("eligibility_status")).contains("manual_review")
        | F.array_contains("source_statuses", "manual_review")
    )
    df = records
    for test, value in (
        (F.col("mapped"), has_source),
        (F.col("source_active"), source_active),
        (F.col("institution_active"), institution_active),
        (F.coalesce(review, F.lit(False)), manual_review),
    ):
        if value is not None:
            df = df.filter(test == F.lit(value))  # an unknown activity is null and never matches
    order = [squash(F.col("region")), squash(F.col("state")), squash_fold(F.col("official_name")), squash(F.col("official_code"))]
    sheet = df.select(
        "official_code", "official_name", "initials", "state", "region",
        "administrative_category_code", "administrative_category",
        "academic_organization_code", "academic_organization",
        "eligibility_status", "coverage_status", "coverage_notes",
        F.col("mapped_sources").alias("source_count"), "source_statuses",
        F.col("mapped").alias("has_source"), "registered", "institution_active", "source_active",
        "capture_validated", "active_monitoring",
    )
    return df.agg(F.count("*").alias("total")), page(sheet, order, skip, limit)

