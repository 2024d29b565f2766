"""Catalog into registry: tiered resolution, merge, change statistics, safe publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeflow.functions.staging import stage
from noticeflow.functions.text import identity_token, squash
from noticeflow.functions.urls import catalog_url
from noticeflow.functions.values import is_blank
from noticeflow.operators.catalog import is_included
from noticeflow.operators.checks import check_unique, require_empty, side_by_side, union_all
from noticeflow.session import joins_by_rows, materialize
from noticeflow.sources import sinks

# Registry column -> catalog column of the fields the catalog owns.
INSTITUTION_FIELDS = {
    "official_code": "official_code",
    "state": "state",
    "region": "region",
    "administrative_category_code": "administrative_category_code",
    "administrative_category": "administrative_category",
    "academic_organization_code": "academic_organization_code",
    "academic_organization": "academic_organization",
    "eligibility_status": "eligibility_status",
    "source_discovery_status": "coverage_status",
    "source_discovery_notes": "coverage_notes",
}
SOURCE_FIELDS = {
    "catalog_source_id": "catalog_source_id",
    "name": "name",
    "source_type": "source_type",
    "recommended_spider": "recommended_spider",
    "coverage_status": "status",
    "priority": "priority",
    "url": "url",
    "normalized_url": "url",
}


def split_eligible(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eligible rows, one row of ignored, pending and manual_review counts)."""
    included = is_included(F.col("eligibility_status"))
    status = F.coalesce("coverage_status", F.lit(""))
    counts = catalog.agg(
        F.count_if(~included).alias("ignored"),
        F.count_if(included & (status != "verified")).alias("pending"),
        F.count_if(included & (status == "manual_review")).alias("manual_review"),
    )
    return catalog.filter(included), counts


def _keyed(df: DataFrame, initials: Column, name: Column) -> DataFrame:
    return stage(
        df, _i=identity_token(initials), _s=F.upper(F.coalesce("state", F.lit(""))), _n=identity_token(name)
    )


def catalog_keys(eligible: DataFrame) -> DataFrame:
    """Eligible rows with their token keys; rows without initials have none."""
    official = F.col("official_initials") if "official_initials" in eligible.columns else F.lit(None)
    initials = F.coalesce(F.nullif(official.cast("string"), F.lit("")), F.col("initials"))
    return _keyed(eligible, initials, F.col("official_name"))


def key_counts(eligible: DataFrame) -> DataFrame:
    """Keys that several eligible rows share: kind, initials, state, name, n."""
    keyed = catalog_keys(eligible).filter("_i <> ''")
    by_initials = check_unique(keyed, "_i", "_s").select(
        F.lit("initials").alias("kind"), F.col("_i").alias("initials"), F.col("_s").alias("state"),
        F.lit(None).cast("string").alias("name"), "n",
    )
    by_identity = check_unique(keyed, "_i", "_s", "_n").select(
        F.lit("identity").alias("kind"), F.col("_i").alias("initials"), F.col("_s").alias("state"),
        F.col("_n").alias("name"), "n",
    )
    return by_initials.unionByName(by_identity)


def _tier(universe: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]):
    """(matches, conflicts) of one key tier.

    Both sides shrink to one row per key (count and least member) before they meet, so a
    heavily shared key never multiplies.
    """
    total = universe.filter("_i <> ''").groupBy(*keys).agg(F.count("*").alias("_total"))
    waiting = left.filter("_i <> ''").groupBy(*keys).agg(F.min("official_code").alias("official_code"))
    found = right.groupBy(*keys).agg(F.count("*").alias("_found"), F.min("id").alias("id"))
    met = waiting.join(total, keys).join(found, keys)
    unique = (F.col("_total") == 1) & (F.col("_found") == 1)
    return met.filter(unique).select("official_code", "id"), met.filter(~unique).select(
        "official_code", F.concat_ws("/", *keys).alias("value"),
        F.when(F.col("_total") > 1, "ambiguous_in_catalog").otherwise("ambiguous_in_registry").alias("rule"),
    )


@joins_by_rows
def resolve_institutions(eligible: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(official_code, id, tier) per matched row, and conflicts (official_code, value, rule).

    Tier 1 by code, tier 2 by initials+state+name, tier 3 by initials+state; the last two
    look only at registry rows without a code and each tier only at what is left.
    """
    # Narrow key tables that every tier reads: computed once, written.
    keyed = materialize(catalog_keys(eligible).select("official_code", "_i", "_s", "_n"), "catalog-keys")
    registry = materialize(registry.select("id", "official_code", "initials", "state", "name"), "registry-keys")
    code = F.trim(F.coalesce("official_code", F.lit("")))
    coded = registry.withColumn("official_code", code).filter("official_code <> ''").select("official_code", "id")
    one_per_code = coded.groupBy("official_code").agg(F.min("id").alias("id"))
    first = keyed.select("official_code").join(one_per_code, "official_code")

    codeless = _keyed(registry.filter(is_blank(F.col("official_code"))), F.col("initials"), F.col("name")).select(
        "id", "_i", "_s", "_n"
    )
    left2 = keyed.join(first, "official_code", "left_anti")
    second, conflicts2 = _tier(keyed, left2, codeless, ["_i", "_s", "_n"])
    stuck = second.select("official_code").unionByName(conflicts2.select("official_code"))
    left3 = left2.join(stuck, "official_code", "left_anti")
    third, conflicts3 = _tier(keyed, left3, codeless.join(second, "id", "left_anti"), ["_i", "_s"])

    tiers = [df.withColumn("tier", F.lit(n)) for n, df in enumerate((first, second, third), 1)]
    # Every caller joins the matches several times.
    matches = materialize(union_all([t.select("official_code", "id", "tier") for t in tiers]), "matches")
    twice = check_unique(matches, "id").select(
        F.lit(None).cast("string").alias("official_code"), F.col("id").cast("string").alias("value"),
        F.lit("row_matched_twice").alias("rule"),
    )
    repeated = check_unique(coded, "official_code").select(
        "official_code", F.col("official_code").alias("value"), F.lit("duplicate_code_in_registry").alias("rule")
    )
    return matches, union_all([conflicts2, conflicts3, twice, repeated])


def changed(pairs: list[tuple[Column, Column]]) -> Column:
    """True when any pair differs, nulls compared as values."""
    test = F.lit(False)
    for old, new in pairs:
        test = test | ~old.eqNullSafe(new)
    return test


def diff_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, action: created, updated or ignored, by null-safe comparison of columns."""
    o = old.select(F.col(key), F.struct(*columns).alias("_old"))
    n = new.select(F.col(key), F.struct(*columns).alias("_new"))
    joined = n.join(o, key, "left")
    action = F.when(F.col("_old").isNull(), "created").when(
        changed([(F.col(f"_old.{c}"), F.col(f"_new.{c}")) for c in columns]), "updated"
    ).otherwise("ignored")
    return joined.select(key, action.alias("action"))


@joins_by_rows
def new_ids(keys: DataFrame, key: str, existing: DataFrame) -> DataFrame:
    """(key, id): ids of new rows, dense and in the order of keys, above every existing id.

    Keys are sorted over the cluster and written; counts per partition, one row per task, give
    each partition its first id. No id depends on a hash, so none can meet another row's.
    """
    ordered = keys.select(key).distinct().orderBy(key).withColumn("_at", F.monotonically_increasing_id())
    table = materialize(ordered, "new-keys")
    sizes = table.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    starts = []
    for row in sizes:
        starts.append((row["_part"], last))
        last += row["n"]
    before = table.sparkSession.createDataFrame(starts, "_part long, _last long")
    placed = table.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return placed.select(key, (F.col("_last") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("_new_id"))


def upsert_institutions(eligible: DataFrame, registry: DataFrame, matches: DataFrame) -> DataFrame:
    """The whole registry after the merge, plus ``action`` (null for untouched rows).

    A new row takes every catalog field and is inactive while its creation is pending; an
    existing row keeps name, initials, activity and a site it already has.
    """
    situation = F.col("current_situation") if "current_situation" in eligible.columns else F.lit(None)
    fields = {c: F.col(s) for c, s in INSTITUTION_FIELDS.items() if s in eligible.columns}
    found = eligible.join(matches.select("official_code", "id"), "official_code", "left")
    ids = new_ids(eligible.join(matches.select("official_code"), "official_code", "left_anti"), "official_code", registry)
    incoming = found.join(ids, "official_code", "left").select(
        F.coalesce("id", "_new_id").alias("id"),
        F.struct(
            *[c.alias(n) for n, c in fields.items()],
            F.col("official_name").alias("_name"),
            F.col("initials").alias("_initials"),
            F.col("official_site_url").alias("_site"),
            F.coalesce(situation.cast("string") != "created_pending_implementation", F.lit(True)).alias("_active"),
        ).alias("c"),
    )
    current = registry.select("id", F.struct(*[c for c in registry.columns if c != "id"]).alias("r"))
    joined = current.join(incoming, "id", "full_outer")
    given, known = F.col("c").isNotNull(), F.col("r").isNotNull()
    fill_site = is_blank(F.col("r.official_site_url")) & ~is_blank(F.col("c._site"))
    differs = changed([(F.col(f"r.{n}"), F.col(f"c.{n}")) for n in fields]) | fill_site
    out = {n: F.when(given, F.col(f"c.{n}")).otherwise(F.col(f"r.{n}")) for n in fields}
    out["name"] = F.when(known, F.col("r.name")).otherwise(F.col("c._name"))
    out["initials"] = F.when(known, F.col("r.initials")).otherwise(F.col("c._initials"))
    out["is_active"] = F.when(known, F.col("r.is_active")).otherwise(F.col("c._active"))
    out["official_site_url"] = F.when(~known | (given & fill_site), F.col("c._site")).otherwise(
        F.col("r.official_site_url")
    )
    others = [c for c in registry.columns if c != "id" and c not in out]
    action = F.when(~given, None).when(~known, "created").when(differs, "updated").otherwise("ignored")
    return joined.select(
        "id",
        *[c.alias(n) for n, c in out.items()],
        *[F.col(f"r.{c}").alias(c) for c in others],
        action.alias("action"),
    )


def _url_key(sources: DataFrame) -> Column:
    return catalog_url(F.coalesce(F.nullif("normalized_url", F.lit("")), F.col("url")))["url"]


@joins_by_rows
def resolve_sources(
    catalog_sources: DataFrame, sources: DataFrame, rules: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(catalog_source_id, id, replaced) matches, and conflicts (catalog_source_id, rule).

    ``catalog_sources``: institution_id (resolved), catalog_source_id, url, replaces.
    ``rules`` adds replaces values as rows: catalog_source_id, value.
    Order: same catalog id, then an explicit replaces rule (by id, URL or name token),
    then the same URL.  Rows matched by id are out of reach for the later steps.
    """
    # Narrow key tables that every step reads: computed once, written.
    wanted = materialize(catalog_sources.select("institution_id", "catalog_source_id", "url", "replaces"), "wanted")
    existing = stage(
        sources.select("id", "institution_id", "catalog_source_id", "name", "url", "normalized_url"),
        _cid=F.trim(F.coalesce("catalog_source_id", F.lit(""))),
        _url=_url_key(sources),
        _token=identity_token(F.col("name")),
    ).select("id", F.col("institution_id").alias("_owner"), "_cid", "_url", "_token")
    existing = materialize(existing, "existing")

    by_id = existing.filter("_cid <> ''").groupBy("_cid").agg(
        F.count("*").alias("_n"), F.min("id").alias("id"), F.min("_owner").alias("_owner")
    )
    # Rows of ids that several steps and callers read: computed once, written.
    direct = wanted.join(by_id, F.col("catalog_source_id") == F.col("_cid")).select(
        "catalog_source_id", "id", "institution_id", "_owner", "_n"
    )
    direct = materialize(direct, "direct")
    matched = direct.select("catalog_source_id", "id", F.lit(False).alias("replaced"))

    rest = wanted.join(direct.select("catalog_source_id"), "catalog_source_id", "left_anti")
    free = existing.join(direct.select("id"), "id", "left_anti")
    value = F.col("_value")
    as_url = catalog_url(value)["url"]
    values = rest.select("catalog_source_id", "institution_id", F.explode("replaces").alias("_value"))
    if rules is not None:
        more = rules.select("catalog_source_id", F.col("value").alias("_value"))
        values = values.unionByName(rest.select("catalog_source_id", "institution_id").join(more, "catalog_source_id"))
    rule_keys = stage(values, _as_url=as_url, _token=identity_token(value)).select(
        "catalog_source_id",
        "institution_id",
        F.inline(F.array_compact(F.array(
            F.struct(F.lit("id").alias("_kind"), squash(value).alias("_key")),
            F.when(F.col("_as_url").isNotNull(), F.struct(F.lit("url").alias("_kind"), F.col("_as_url").alias("_key"))),
            F.when(F.col("_as_url").isNull(), F.struct(F.lit("token").alias("_kind"), F.col("_token").alias("_key"))),
        ))),
    )
    url_keys = rest.select("catalog_source_id", "institution_id", F.lit("same").alias("_kind"), F.col("url").alias("_key"))
    row_keys = free.select(
        "id", F.col("_owner").alias("institution_id"), "_cid",
        F.inline(F.array_compact(F.array(
            F.when(F.col("_cid") != "", F.struct(F.lit("id").alias("_kind"), F.col("_cid").alias("_key"))),
            F.struct(F.lit("url").alias("_kind"), F.col("_url").alias("_key")),
            F.struct(F.lit("token").alias("_kind"), F.col("_token").alias("_key")),
            F.struct(F.lit("same").alias("_kind"), F.col("_url").alias("_key")),
        ))),
    ).filter("_key is not null")
    # One certificate per key (least and greatest row, greatest catalog id) meets each wish, so a
    # key that many rows share on both sides never multiplies. A wish with several keys has one
    # row exactly when the least of all is the greatest of all.
    held = row_keys.groupBy("institution_id", "_kind", "_key").agg(
        F.min("id").alias("_low"), F.max("id").alias("_high"), F.max("_cid").alias("_cid"))
    hits = rule_keys.unionByName(url_keys).join(held, ["institution_id", "_kind", "_key"])
    exact = F.col("_kind") == "same"
    per = hits.groupBy("catalog_source_id").agg(
        F.min(F.when(~exact, F.col("_low"))).alias("_rule_id"), F.max(F.when(~exact, F.col("_high"))).alias("_rule_high"),
        F.min(F.when(exact, F.col("_low"))).alias("_url_id"), F.max(F.when(exact, F.col("_high"))).alias("_url_high"),
        F.max(F.when(exact, F.col("_cid"))).alias("_url_cid"),
    )
    by_rule, by_url = F.col("_rule_id").isNotNull(), F.col("_url_id").isNotNull()
    problem = (
        F.when(F.col("_rule_id") != F.col("_rule_high"), "replaces_matches_several")
        .when(F.col("_url_id") != F.col("_url_high"), "url_matches_several")
        .when(by_rule & by_url & (F.col("_rule_id") != F.col("_url_id")), "url_and_replaces_disagree")
        .when(~by_rule & (F.col("_url_cid") != ""), "url_owned_by_other_id")
    )
    judged = materialize(stage(per, rule=problem).select("catalog_source_id", "rule", "_rule_id", "_url_id"), "judged")
    later = judged.filter("rule is null").select(
        "catalog_source_id",
        F.coalesce("_rule_id", "_url_id").alias("id"),
        F.col("_rule_id").isNotNull().alias("replaced"),
    )
    matches = matched.unionByName(later)
    conflicts = union_all([
        judged.filter("rule is not null").select("catalog_source_id", "rule"),
        direct.filter(F.col("_owner") != F.col("institution_id")).select(
            "catalog_source_id", F.lit("id_of_other_institution").alias("rule")),
        direct.filter("_n > 1").select("catalog_source_id", F.lit("duplicate_id_in_registry").alias("rule")),
        matches.join(check_unique(matches, "id").select("id"), "id", "left_semi").select(
            "catalog_source_id", F.lit("row_matched_twice").alias("rule")),
    ])
    return matches, conflicts


def upsert_sources(catalog_sources: DataFrame, sources: DataFrame, matches: DataFrame) -> DataFrame:
    """The whole source table after the merge, plus ``action`` and ``replaced``.

    New sources start inactive; existing ones keep activity, cadence, crawl times, errors.
    """
    fields = {c: F.col(s) for c, s in SOURCE_FIELDS.items() if s in catalog_sources.columns}
    found = catalog_sources.join(matches, "catalog_source_id", "left")
    ids = new_ids(catalog_sources.join(matches.select("catalog_source_id"), "catalog_source_id", "left_anti"), "catalog_source_id", sources)
    incoming = found.join(ids, "catalog_source_id", "left").select(
        F.coalesce("id", "_new_id").alias("id"),
        F.coalesce("replaced", F.lit(False)).alias("replaced"),
        F.struct(F.col("institution_id").alias("institution_id"), *[c.alias(n) for n, c in fields.items()]).alias("c"),
    )
    current = sources.select("id", F.struct(*[c for c in sources.columns if c != "id"]).alias("r"))
    joined = current.join(incoming, "id", "full_outer")
    given, known = F.col("c").isNotNull(), F.col("r").isNotNull()
    differs = changed([(F.col(f"r.{n}"), F.col(f"c.{n}")) for n in fields])
    out = {n: F.when(given, F.col(f"c.{n}")).otherwise(F.col(f"r.{n}")) for n in fields}
    out["institution_id"] = F.coalesce("r.institution_id", "c.institution_id")
    out["is_active"] = F.coalesce("r.is_active", F.lit(False))
    others = [c for c in sources.columns if c != "id" and c not in out]
    action = F.when(~given, None).when(~known, "created").when(differs, "updated").otherwise("ignored")
    return joined.select(
        "id",
        *[c.alias(n) for n, c in out.items()],
        *[F.col(f"r.{c}").alias(c) for c in others],
        action.alias("action"),
        F.coalesce("replaced", F.lit(False)).alias("replaced"),
    )


def upsert_stats(institutions: DataFrame, sources: DataFrame, ignored: DataFrame) -> DataFrame:
    """One row of counters; a replaced source also counts as updated or ignored.

    ``ignored`` is the count row of :func:`split_eligible`.
    """
    actions = ("created", "updated", "ignored")
    count = lambda name, test: F.count_if(test).alias(name)
    inst = institutions.agg(*[count(f"institutions_{a}", F.col("action") == a) for a in actions])
    src = sources.agg(
        *[count(f"sources_{a}", F.col("action") == a) for a in actions],
        count("sources_replaced", F.col("replaced") & F.col("action").isNotNull()),
    )
    row = side_by_side(inst, src, ignored.withColumnRenamed("ignored", "_ineligible"))
    all_ignored = F.col("institutions_ignored") + F.col("_ineligible")
    return row.select(
        (F.col("institutions_created") + F.col("sources_created")).alias("created"),
        (F.col("institutions_updated") + F.col("sources_updated")).alias("updated"),
        (all_ignored + F.col("sources_ignored")).alias("ignored"),
        F.col("sources_replaced").alias("replaced"),
        "institutions_created", "institutions_updated", all_ignored.alias("institutions_ignored"),
        "sources_created", "sources_updated", "sources_ignored", "sources_replaced",
        "pending", "manual_review",
    )


@joins_by_rows
def publish_upsert(
    institutions: DataFrame, sources: DataFrame, conflicts: list[DataFrame], root: str
) -> dict[str, str]:
    """All or nothing: any conflict raises before a table changes.

    Both tables are written whole and switched in together by one manifest.
    """
    for frame in conflicts:
        require_empty(frame, "catalog conflicts")
    return sinks.publish_set({"institutions": institutions.drop("action"), "sources": sources.drop("action", "replaced")}, root)


def backfill_legacy(institutions: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill the fields older rows lack and mark those rows for review."""
    old_inst = F.col("eligibility_status").isNull()
    old_src = F.col("normalized_url").isNull()
    review = F.lit("manual_review")
    return (
        institutions.withColumns({
            "source_discovery_status": F.when(old_inst, review).otherwise(F.col("source_discovery_status")),
            "eligibility_status": F.coalesce("eligibility_status", F.lit("included_legacy")),
        }),
        sources.withColumns({
            "coverage_status": F.when(old_src, review).otherwise(F.col("coverage_status")),
            "normalized_url": F.coalesce("normalized_url", "url"),
        }),
    )
