"""V rows: coverage of the catalog by the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.operators import coverage
from noticeflow.workload.domain import NOW
from noticeflow.workload.registry import query


def sources(t):
    """Catalog sources; one state has none and some parts lack theirs."""
    thin = t.cat.filter("state <> 'NATION_12'").select("official_code")
    kept = t.csr.filter("priority < 3 OR p_type <> 'PROMO'").join(thin, "official_code", "left_semi")
    return kept.select("official_code", "status", "recommended_spider", F.col("capture_at").alias("capture_validated_at"),
                       F.col("verified_at").alias("last_verified_at"))


_SRC = """SELECT csr.* FROM csr JOIN cat ON cat.official_code = csr.official_code
  WHERE (csr.priority < 3 OR p_type <> 'PROMO') AND state <> 'NATION_12'"""
_CLAIM = """
SELECT official_code, registry_id FROM (
  SELECT c.official_code, c.catalog_order, coalesce(a.id, b.id, d.id, e.id) AS registry_id FROM cat c
  LEFT JOIN (SELECT official_code, max(id) AS id FROM reg WHERE official_code IS NOT NULL GROUP BY official_code) a ON a.official_code = c.official_code
  LEFT JOIN (SELECT k.initials, k.state, k.name, k.id FROM (SELECT initials, state, name, min(id) AS id FROM reg WHERE official_code IS NULL GROUP BY initials, state, name HAVING count(*) = 1) k
    JOIN (SELECT initials, state, official_name FROM cat GROUP BY initials, state, official_name HAVING count(*) = 1) u
      ON u.initials = k.initials AND u.state = k.state AND u.official_name = k.name) b
    ON b.initials = c.initials AND b.state = c.state AND b.name = c.official_name
  LEFT JOIN (SELECT k.initials, k.state, k.id FROM (SELECT initials, state, min(id) AS id FROM reg WHERE official_code IS NULL GROUP BY initials, state HAVING count(*) = 1) k
    JOIN (SELECT initials, state FROM cat GROUP BY initials, state HAVING count(*) = 1) u ON u.initials = k.initials AND u.state = k.state) d
    ON d.initials = c.initials AND d.state = c.state
  LEFT JOIN (SELECT k.name, k.state, k.id FROM (SELECT name, state, min(id) AS id FROM reg WHERE official_code IS NULL GROUP BY name, state HAVING count(*) = 1) k
    JOIN (SELECT official_name, state FROM cat GROUP BY official_name, state HAVING count(*) = 1) u ON u.official_name = k.name AND u.state = k.state) e
    ON e.name = c.official_name AND e.state = c.state)
WHERE registry_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY registry_id ORDER BY catalog_order) = 1"""
_RECENT = f"""coalesce(is_active AND last_success_at >= {NOW} - to_minutes(CAST(greatest(2 * greatest(coalesce(nullif(check_frequency_minutes, 0), 1440), 1), 1440) AS BIGINT)), false)"""
_REC = f"""
SELECT c.*, k.registry_id, starts_with(c.eligibility_status, 'included') AS eligible, k.registry_id IS NOT NULL AS registered,
  coalesce(s.n, 0) AS mapped_sources, coalesce(s.n, 0) > 0 AS mapped, coalesce(s.ver, false) AS verified,
  coalesce(s.cap, false) OR coalesce(o.cap, false) AS capture_validated, coalesce(o.recent, false) AS active_monitoring,
  coalesce(o.act, false) AS source_active, r.is_active AS institution_active, s.statuses
FROM cat c LEFT JOIN clm k ON k.official_code = c.official_code LEFT JOIN reg r ON r.id = k.registry_id
LEFT JOIN (SELECT official_code, count(*) AS n, coalesce(bool_or(status = 'verified'), false) AS ver, bool_or(capture_at IS NOT NULL) AS cap,
    string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM csx GROUP BY official_code) s ON s.official_code = c.official_code
LEFT JOIN (SELECT institution_id, bool_or(is_active) AS act, bool_or({_RECENT}) AS recent, bool_or(capture_validated_at IS NOT NULL) AS cap
  FROM rsr GROUP BY institution_id) o ON o.institution_id = k.registry_id"""
REC = {"csx": _SRC, "clm": _CLAIM, "rec": _REC}


def records(t):
    links = coverage.link_registry(t.cat, t.reg)
    return coverage.coverage_records(t.cat, sources(t), links, t.reg, t.rsr, F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query("v01_filter_catalog", """
SELECT 'place' AS f, official_code FROM cat WHERE region = 'ASIA' AND state = 'NATION_8'
UNION ALL SELECT 'codes', official_code FROM cat WHERE administrative_category_code = 2 AND academic_organization_code = 3 AND eligibility_status = 'included'
UNION ALL SELECT 'verification', official_code FROM cat WHERE official_code IN (SELECT official_code FROM csx WHERE status = 'temporarily_unavailable')
UNION ALL SELECT 'any', official_code FROM cat WHERE coverage_status = 'source_not_found' OR official_code IN (SELECT official_code FROM csx WHERE status = 'source_not_found')""", csx=_SRC)
def _(t):
    rows = t.cat, sources(t)
    lists = {
        "place": coverage.filter_catalog(*rows, region=" asia ", state="Nation_8"),
        "codes": coverage.filter_catalog(*rows, administrative_category_code=2, academic_organization_code=3, eligibility_status="INCLUDED"),
        "verification": coverage.filter_catalog(*rows, verification_status="Temporarily_Unavailable"),
        "any": coverage.filter_catalog(*rows, source_status="source_not_found"),
    }
    parts = [df.select(F.lit(n).alias("f"), "official_code") for n, df in lists.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("v02_link_registry", "SELECT * FROM clm", clm=_CLAIM)
def _(t):
    return coverage.link_registry(t.cat, t.reg)


@query("v03_claim_once", "SELECT * FROM clm", clm=_CLAIM)
def _(t):
    # Every row again, later and under another code: a claimed registry row is not shared.
    rows = t.cat
    again = rows.withColumn("official_code", F.concat(F.lit("D"), "official_code")).withColumn("catalog_order", F.col("catalog_order") + 10**9)
    return coverage.link_registry(rows.unionByName(again), t.reg, rows)


@query("v04_coverage_records", """
SELECT official_code, eligible, registered, mapped, mapped_sources, verified, capture_validated, active_monitoring, source_active, institution_active FROM rec""", **REC)
def _(t):
    return records(t).select("official_code", "eligible", "registered", "mapped", "mapped_sources", "verified",
                             "capture_validated", "active_monitoring", "source_active", "institution_active")


@query("v05_is_recent", f"SELECT id, {_RECENT} AS recent FROM src")
def _(t):
    return t.src.select("id", coverage.is_recent(F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("recent"))


_STAGE = ("SELECT '{s}' AS stage, count(*) FILTER (WHERE {s}) AS institutions, "
          "coalesce(round_even(count(*) FILTER (WHERE {s}) * 100.0::DOUBLE / nullif(count(*), 0), 2), 0.0) AS percent FROM rec WHERE eligible")


@query("v06_coverage_funnel", " UNION ALL ".join(_STAGE.format(s=s) for s in coverage.STAGES), **REC)
def _(t):
    return coverage.coverage_funnel(records(t))


@query("v07_coverage_totals", """
SELECT count(*) AS inventory_total, count(*) FILTER (WHERE NOT law) AS census_raw_total, count(*) FILTER (WHERE NOT law AND eligible) AS eligible_census_total,
  count(*) FILTER (WHERE law) AS post_census_total, count(*) FILTER (WHERE eligible) AS eligible_total,
  CAST(sum(mapped_sources) AS BIGINT) AS mapped_sources_inventory, CAST(coalesce(sum(mapped_sources) FILTER (WHERE eligible), 0) AS BIGINT) AS mapped_sources_eligible,
  count(*) FILTER (WHERE eligible AND mapped) AS with_source, count(*) FILTER (WHERE eligible AND NOT mapped) AS without_source,
  count(*) FILTER (WHERE eligible AND verified) AS verified, count(*) FILTER (WHERE eligible AND coverage_status = 'partial') AS partial,
  count(*) FILTER (WHERE eligible AND coverage_status = 'manual_review') AS manual_review, count(*) FILTER (WHERE eligible AND coverage_status = 'source_not_found') AS source_not_found,
  count(*) FILTER (WHERE eligible AND capture_validated) AS captured, count(*) FILTER (WHERE eligible AND active_monitoring) AS active
FROM (SELECT *, official_code_origin = 'post_census_law' AS law FROM rec)""", **REC)
def _(t):
    return coverage.coverage_totals(records(t))


_BREAK = """
SELECT '{d}' AS dimension, CAST({k} AS VARCHAR) AS key, min({l}) AS label, count(*) AS inventory_total, count(*) FILTER (WHERE eligible) AS eligible_total,
  CAST(coalesce(sum(mapped_sources) FILTER (WHERE eligible), 0) AS BIGINT) AS mapped_sources,
  count(*) FILTER (WHERE eligible AND mapped) AS institutions_with_source, count(*) FILTER (WHERE eligible AND NOT mapped) AS institutions_without_source,
  count(*) FILTER (WHERE eligible AND verified) AS verified, count(*) FILTER (WHERE eligible AND coverage_status = 'partial') AS partial,
  count(*) FILTER (WHERE eligible AND coverage_status = 'manual_review') AS manual_review, count(*) FILTER (WHERE eligible AND coverage_status = 'source_not_found') AS source_not_found,
  count(*) FILTER (WHERE eligible AND capture_validated) AS capture_validated, count(*) FILTER (WHERE eligible AND active_monitoring) AS active_monitoring
FROM rec GROUP BY {k}"""


@query("v08_coverage_breakdown", " UNION ALL ".join(
    _BREAK.format(d=d, k=k, l=label or k) for d, (k, label) in coverage.DIMENSIONS.items()), **REC)
def _(t):
    return coverage.coverage_breakdown(records(t))


@query("v09_spider_breakdown", """
SELECT recommended_spider AS spider, count(*) AS sources, count(DISTINCT rec.official_code) AS institutions
FROM csx JOIN rec ON rec.official_code = csx.official_code WHERE eligible GROUP BY recommended_spider""", **REC)
def _(t):
    return coverage.spider_breakdown(records(t), sources(t))


@query("v10_status_counts", """
SELECT 'institution' AS grain, coverage_status AS status, count(*) AS n FROM rec WHERE eligible GROUP BY coverage_status
UNION ALL SELECT 'source', coalesce(status, 'unknown'), count(*) FROM csx JOIN rec ON rec.official_code = csx.official_code WHERE eligible GROUP BY status""", **REC)
def _(t):
    return coverage.status_counts(records(t), sources(t))


@query("v11_pending_list", """
SELECT official_code, official_name, state, region, coverage_status AS status,
  coalesce(coverage_notes, CASE WHEN mapped THEN 'A fonte mapeada ainda não possui verificação integral.' ELSE 'Nenhuma fonte oficial mapeada.' END) AS reason
FROM rec WHERE eligible AND NOT (coverage_status = 'verified' AND verified)""", **REC)
def _(t):
    return coverage.pending_list(records(t))


@query("v12_last_audit", "SELECT greatest(max(substr(verified_at, 1, 10)), '2026-07-14') AS last_audit FROM csx", csx=_SRC)
def _(t):
    return coverage.last_audit(sources(t), {"audited_at": "2026-07-14T08:00:00Z", "note": "2027-01-01", "verified": "soon"})


_SHEET = """rec WHERE mapped AND source_active AND institution_active IS NOT DISTINCT FROM true"""
# A reviewed source counts its institution as reviewed.
_REVIEW = "(coverage_status = 'manual_review' OR contains(eligibility_status, 'manual_review') OR list_contains(string_split(coalesce(statuses, ''), ','), 'manual_review'))"


@query("v13_coverage_institutions", " UNION ALL ".join(f"""
SELECT {flag} AS reviewed, official_code, coalesce(statuses, '') AS source_statuses, mapped_sources AS source_count
FROM (SELECT * FROM {_SHEET} AND {_REVIEW} = {flag} ORDER BY region, state, lower(official_name), official_code LIMIT 10 OFFSET 2)
UNION ALL SELECT {flag}, 'total', '', count(*) FROM {_SHEET} AND {_REVIEW} = {flag}""" for flag in ("true", "false")), **REC)
def _(t):
    def pages(reviewed):
        total, sheet = coverage.coverage_institutions(
            records(t), has_source=True, source_active=True, institution_active=True, manual_review=reviewed, skip=2, limit=10)
        rows = sheet.select("official_code", F.array_join("source_statuses", ",").alias("source_statuses"), "source_count")
        both = rows.unionByName(total.select(F.lit("total").alias("official_code"), F.lit("").alias("source_statuses"), F.col("total").alias("source_count")))
        return both.select(F.lit(reviewed).alias("reviewed"), "*")

    return pages(True).unionByName(pages(False))
