"""Catalog: validation of manifest documents, reconciliation, merge and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeflow.functions.text import squash
from noticeflow.functions.urls import catalog_url, host_form, idna_host, with_host_forms
from noticeflow.functions.values import code_order
from noticeflow.lexicon import COVERAGE_STATUSES, EXTRACTORS, REGIONS
from noticeflow.operators.checks import check_unique, side_by_side, union_all, violations

# Published totals of the versioned catalog.
EXPECTED_TOTALS = {"raw_total": 317, "eligible_census_total": 315, "post_census_total": 3, "coverage_target_total": 318}

_OPTIONAL_TEXT = (
    "last_verified_at", "page_title", "verification_evidence", "verification_notes",
    "capture_validated_at", "capture_evidence",
)


class Fields:
    """Typed access to one variant column: values plus their JSON kinds."""

    def __init__(self, column: str):
        self.column = column

    def get(self, name: str, kind: str = "string") -> Column:
        return F.try_variant_get(self.column, f"$.{name}", kind)

    def kind(self, name: str) -> Column:
        """JSON kind: null when the key is absent, VOID for an explicit null."""
        return F.schema_of_variant(self.get(name, "variant"))

    def text(self, name: str) -> Column:
        """Stripped text of a string value, null for any other kind."""
        return F.when(self.kind(name) == "STRING", _strip(self.get(name)))

    def has_text(self, name: str) -> Column:
        return F.coalesce(self.text(name) != "", F.lit(False))

    def absent(self, name: str) -> Column:
        return F.coalesce(self.kind(name) == "VOID", F.lit(True))

    def items(self, name: str) -> Column:
        """A list value as array<variant>, a bare string as a list of one."""
        return (
            F.when(self.kind(name) == "STRING", F.array(self.get(name, "variant")))
            .when(self.kind(name).startswith("ARRAY"), self.get(name, "array<variant>"))
        )

    def strings(self, name: str) -> Column:
        """Stripped strings of a list value; other elements are null, no list is empty."""
        texts = F.transform(
            self.items(name),
            lambda v: F.when(F.schema_of_variant(v) == "STRING", _strip(F.try_variant_get(v, "$", "string"))),
        )
        return F.coalesce(texts, F.array().cast("array<string>"))


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+$", "")


def _url_error(url: Column, idna=idna_host) -> Column:
    return catalog_url(url, idna=idna)["error"].isNotNull()


def _normal(url: Column, idna=idna_host) -> Column:
    return catalog_url(url, idna=idna)["url"]


def _with_hosts(sources: DataFrame, f: Fields) -> DataFrame:
    """Sources with the dictionary of the international hosts in any of their URLs."""
    single = F.array(f.text("url"), f.text("final_url"))
    return with_host_forms(sources, F.concat(single, f.strings("redirect_chain"), f.strings("replaces")))


def _replaced(values: Column) -> Column:
    """Replaced ids and names as they are, replaced URLs normal; needs the dictionary."""
    return F.transform(values, lambda v: F.when(v.contains("://"), _normal(v, host_form())).otherwise(v))


def check_sources(sources: DataFrame) -> DataFrame:
    """Broken source rules: official_code, source_pos, field, rule.

    Values keep their JSON type, so 1, "1" and true stay apart.
    """
    f = Fields("source")
    number = f.get("http_status", "long")
    lists = {name: f.strings(name) for name in ("redirect_chain", "categories", "replaces")}
    staged = _with_hosts(sources, f).select(
        "official_code", "source_pos", "source", "_hosts", *[c.alias(f"_{n}") for n, c in lists.items()])

    def list_rules(name: str):
        col = F.col(f"_{name}")
        wrong_kind = ~f.absent(name) & ~f.kind(name).rlike("^(STRING|ARRAY)")
        return [
            (name, "not_a_list", wrong_kind),
            (name, "empty_item", F.exists(col, lambda v: F.coalesce(v == "", F.lit(True)))),
            (name, "duplicate", F.size(F.array_distinct(col)) != F.size(col)),
        ]

    replaced = _replaced(F.col("_replaces"))
    bad_url = lambda v: _url_error(v, host_form())
    rules = [
        *[(n, "required", ~f.has_text(n)) for n in ("catalog_source_id", "name", "source_type", "content_type")],
        ("url", "required", ~f.has_text("url")),
        ("url", "invalid", f.has_text("url") & bad_url(f.text("url"))),
        ("recommended_spider", "unsupported", ~F.coalesce(f.text("recommended_spider").isin(*EXTRACTORS), F.lit(False))),
        ("status", "unsupported", ~F.coalesce(f.text("status").isin(*COVERAGE_STATUSES), F.lit(False))),
        ("is_active", "not_boolean", f.kind("is_active") != "BOOLEAN"),
        ("http_status", "invalid", ~f.absent("http_status")
         & ~F.coalesce((f.kind("http_status") == "BIGINT") & number.between(100, 599), F.lit(False))),
        *[(n, "not_text", ~f.absent(n) & (f.kind(n) != "STRING")) for n in _OPTIONAL_TEXT],
        ("final_url", "invalid", ~f.absent("final_url") & (~f.has_text("final_url") | bad_url(f.text("final_url")))),
        *list_rules("redirect_chain"),
        ("redirect_chain", "invalid_url", F.exists("_redirect_chain", bad_url)),
        ("priority", "invalid", ~F.coalesce(
            (f.kind("priority") == "BIGINT") & f.get("priority", "long").between(1, 3), F.lit(False))),
        *list_rules("categories"),
        *list_rules("replaces"),
        ("replaces", "duplicate_normalized", F.size(F.array_distinct(replaced)) != F.size(replaced)),
    ]
    return violations(staged, ["official_code", "source_pos"], rules)


def typed_sources(sources: DataFrame) -> DataFrame:
    """Sources as plain columns, URLs normal, blanks null; a value of a wrong kind is null."""
    f = Fields("source")
    blank_null = lambda n: F.nullif(f.text(n), F.lit("")).alias(n)
    normal = lambda v: _normal(v, host_form())
    whole = lambda n: F.when(f.kind(n) == "BIGINT", f.get(n, "int")).alias(n)
    return _with_hosts(sources, f).select(
        "official_code",
        "source_pos",
        *[f.text(n).alias(n) for n in ("catalog_source_id", "name", "source_type", "content_type", "recommended_spider", "status")],
        normal(f.text("url")).alias("url"),
        F.coalesce(f.get("is_active", "boolean"), F.lit(False)).alias("is_active"),
        whole("http_status"),
        normal(f.text("final_url")).alias("final_url"),
        F.transform(f.strings("redirect_chain"), normal).alias("redirect_chain"),
        whole("priority"),
        f.strings("categories").alias("categories"),
        _replaced(f.strings("replaces")).alias("replaces"),
        *[blank_null(n) for n in _OPTIONAL_TEXT],
    )


def check_entries(entries: DataFrame, base: DataFrame) -> DataFrame:
    """Broken entry rules: region, official_code, field, rule.  ``base``: official_code, region."""
    f = Fields("entry")
    known = base.select(F.col("official_code").alias("_code"), F.col("region").alias("_home"))
    staged = entries.withColumn("_code", f.text("official_code")).join(known, "_code", "left")
    code, status = F.col("_code"), f.text("eligibility_status")
    has_eligibility = f.kind("eligibility_status").isNotNull()
    rules = [
        ("official_code", "not_numeric", ~F.coalesce(code.rlike(r"^\p{Nd}+$"), F.lit(False))),
        ("official_code", "unknown", F.col("_home").isNull()),
        ("official_code", "wrong_region", F.col("_home") != F.col("region")),
        ("official_site_url", "invalid", ~f.absent("official_site_url")
         & (~f.has_text("official_site_url") | _url_error(f.text("official_site_url")))),
        ("coverage_status", "unsupported", ~F.coalesce(f.text("coverage_status").isin(*COVERAGE_STATUSES), F.lit(False))),
        ("coverage_notes", "not_text", ~f.absent("coverage_notes") & (f.kind("coverage_notes") != "STRING")),
        ("eligibility_status", "unsupported",
         has_eligibility & ~F.coalesce(status.rlike("^(included|excluded)"), F.lit(False))),
        ("sources", "not_a_list", ~F.coalesce(f.kind("sources").startswith("ARRAY"), F.lit(False))),
    ]
    return violations(staged, ["region", code.alias("official_code")], rules)


def typed_entries(entries: DataFrame) -> DataFrame:
    f = Fields("entry")
    return entries.select(
        "region",
        f.text("official_code").alias("official_code"),
        _normal(f.text("official_site_url")).alias("official_site_url"),
        f.text("coverage_status").alias("coverage_status"),
        F.nullif(f.text("coverage_notes"), F.lit("")).alias("coverage_notes"),
        f.kind("eligibility_status").isNotNull().alias("has_eligibility"),
        f.text("eligibility_status").alias("eligibility_status"),
        F.nullif(f.text("eligibility_reason"), F.lit("")).alias("eligibility_reason"),
    )


def check_keys(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Keys that must be unique but are not: key, value, n."""
    named = lambda df, key, *cols: df.select(
        F.lit(key).alias("key"), F.concat_ws(" ", *cols).alias("value"), "n"
    )
    return union_all([
        named(check_unique(sources, "catalog_source_id"), "catalog_source_id", "catalog_source_id"),
        named(check_unique(entries, "official_code"), "official_code", "official_code"),
        named(check_unique(sources, "official_code", "url"), "source_url", "official_code", "url"),
    ])


def reconcile_codes(base: DataFrame, entries: DataFrame) -> DataFrame:
    """Codes on one side only: official_code, side ('missing' or 'extra' in the manifests)."""
    have, want = entries.select("official_code").distinct(), base.select("official_code").distinct()
    missing = want.join(have, "official_code", "left_anti").select("official_code", F.lit("missing").alias("side"))
    extra = have.join(want, "official_code", "left_anti").select("official_code", F.lit("extra").alias("side"))
    return missing.unionByName(extra)


def merge_catalog(base: DataFrame, entries: DataFrame) -> DataFrame:
    """Census rows with their manifest entry; eligibility changes only where the key is given."""
    entry = entries.select(
        "official_code",
        "has_eligibility",
        F.col("eligibility_status").alias("_status"),
        F.col("eligibility_reason").alias("_reason"),
        F.col("official_site_url").alias("_site"),
        "coverage_status",
        "coverage_notes",
    )
    plain = base.drop("coverage_status", "coverage_notes")
    joined = plain.join(entry, "official_code")
    given = F.col("has_eligibility")
    return joined.withColumns({
        "eligibility_status": F.when(given, F.col("_status")).otherwise(F.col("eligibility_status")),
        "eligibility_reason": F.when(given, F.col("_reason")).otherwise(F.col("eligibility_reason")),
        "official_site_url": F.col("_site"),
        "source_discovery_status": F.col("coverage_status"),
        "source_discovery_notes": F.col("coverage_notes"),
    }).drop("has_eligibility", "_status", "_reason", "_site")


def check_overlay(overlay: DataFrame, expected_total: int | None = None) -> DataFrame:
    """Broken overlay rules: official_code, field, rule."""
    f = Fields("entry")
    code = f.text("official_code")
    rules = [
        ("official_code", "prefix", ~F.coalesce(code.startswith("LAW-"), F.lit(False))),
        ("official_code_origin", "unexpected", ~F.coalesce(f.get("official_code_origin") == "post_census_law", F.lit(False))),
        ("inventory_source_url", "invalid", ~f.has_text("inventory_source_url") | _url_error(f.text("inventory_source_url"))),
        ("official_site_url", "invalid", ~f.absent("official_site_url")
         & (~f.has_text("official_site_url") | _url_error(f.text("official_site_url")))),
        ("coverage_status", "unsupported", ~F.coalesce(f.text("coverage_status").isin(*COVERAGE_STATUSES), F.lit(False))),
        ("eligibility_status", "not_included", ~F.coalesce(f.text("eligibility_status").startswith("included"), F.lit(False))),
        ("sources", "not_empty", ~F.coalesce(
            f.kind("sources").startswith("ARRAY") & (F.size(f.get("sources", "array<variant>")) == 0), F.lit(False))),
    ]
    found = [violations(overlay, [code.alias("official_code")], rules)]
    repeated = check_unique(overlay.select(code.alias("official_code")), "official_code")
    found.append(repeated.select("official_code", F.lit("official_code").alias("field"), F.lit("duplicate").alias("rule")))
    if expected_total is not None:
        wrong = overlay.agg(F.count("*").alias("n")).filter(F.col("n") != expected_total)
        found.append(wrong.select(F.lit(None).cast("string").alias("official_code"),
                                  F.lit("institutions").alias("field"), F.lit("total").alias("rule")))
    return union_all(found)


def select_catalog(
    census: DataFrame, overlay: DataFrame | None, regions=None, *, known=REGIONS, include_overlay: bool = True
) -> DataFrame:
    """Selected regions of census and overlay, in catalog order."""
    if isinstance(regions, str):
        regions = [regions]
    chosen = set(known) if regions is None else {r.strip() for r in regions}
    unknown = sorted(chosen - set(known))
    if unknown or not chosen:
        raise ValueError(f"unknown regions {unknown}" if unknown else "regions must not be empty")
    both = census
    if include_overlay and overlay is not None:
        both = census.unionByName(overlay, allowMissingColumns=True)
    picked = both.filter(F.col("region").isin(sorted(chosen)))
    return picked.orderBy("region", "state", *code_order(F.col("official_code")))


def is_included(status: Column) -> Column:
    return F.coalesce(status, F.lit("")).startswith("included")


def catalog_metadata(census: DataFrame, overlay: DataFrame, selected: DataFrame) -> DataFrame:
    """One row of totals over the whole and the selected catalog."""
    included = is_included(F.col("eligibility_status"))
    totals = lambda df, all_name, ok_name: df.agg(
        F.count("*").alias(all_name), F.count_if(included).alias(ok_name)
    )
    whole = totals(census, "raw_total", "eligible_census_total")
    late = totals(overlay, "post_census_total", "_late")
    chosen = totals(selected, "selected_inventory_total", "selected_coverage_target_total")
    return side_by_side(whole, late, chosen).select(
        "raw_total", "eligible_census_total", "post_census_total",
        (F.col("eligible_census_total") + F.col("_late")).alias("coverage_target_total"),
        (F.col("raw_total") + F.col("post_census_total")).alias("inventory_total"),
        "selected_inventory_total", "selected_coverage_target_total",
    )
