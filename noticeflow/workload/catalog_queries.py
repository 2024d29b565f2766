"""C and E rows: catalog validation and build, registry merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.operators import catalog, census, checks, legacy, upsert
from noticeflow.session import scratch_path
from noticeflow.sources import sinks
from noticeflow.workload.crawl_queries import _CENSUS
from noticeflow.workload.registry import query
from noticeflow.workload.scalar_queries import _SLUG

CATEGORIES = {1: "A", 2: "B", 3: "C"}
ORGANIZATIONS = {1: "V", 2: "W", 3: "X", 4: "Y", 5: "Z"}


def cen(t):
    return t.sql(_CENSUS)


@query("c01_filter_census", "SELECT CO_IES FROM cen WHERE NU_ANO_CENSO = '2024' AND TP_REDE = '1'", cen=_CENSUS)
def _(t):
    return census.filter_census(cen(t)).select("CO_IES")


@query("c02_derive_institutions", """
SELECT CO_IES AS official_code, SG_IES AS official_initials, coalesce(SG_IES, 'IES-' || CO_IES) AS initials,
  CASE WHEN SG_IES IS NULL THEN 'generated_fallback' ELSE 'official' END AS initials_origin, SG_UF_IES AS state,
  coalesce(replace(NO_MUNICIPIO_IES, '  ', ' '), '') AS headquarters_city, CAST(TP_ORGANIZACAO_ACADEMICA AS INTEGER) AS organization,
  CASE TP_ORGANIZACAO_ACADEMICA WHEN '1' THEN 'V' WHEN '2' THEN 'W' WHEN '3' THEN 'X' WHEN '4' THEN 'Y' WHEN '5' THEN 'Z' END AS label,
  'included' AS eligibility_status FROM cen""", cen=_CENSUS)
def _(t):
    out = census.derive_institutions(cen(t), CATEGORIES, ORGANIZATIONS)
    return out.select("official_code", "official_initials", "initials", "initials_origin", "state", "headquarters_city",
                      F.col("academic_organization_code").alias("organization"),
                      F.col("academic_organization_label").alias("label"), "eligibility_status")


@query("c03_check_census_rows", """
SELECT CO_IES AS official_code, 'CO_MUNICIPIO_IES' AS field, 'not_numeric' AS rule FROM cen WHERE starts_with(CO_MUNICIPIO_IES, 'x')
UNION ALL SELECT CO_IES, 'NO_MUNICIPIO_IES', 'empty' FROM cen WHERE NO_MUNICIPIO_IES IS NULL
UNION ALL SELECT CO_IES, 'TP_ORGANIZACAO_ACADEMICA', 'unsupported' FROM cen WHERE TP_ORGANIZACAO_ACADEMICA = '6'
UNION ALL SELECT CO_IES, 'SG_UF_IES', 'unknown_state' FROM cen WHERE SG_UF_IES = 'NATION_4'
UNION ALL SELECT CO_IES, 'NO_REGIAO_IES', 'wrong_region' FROM cen WHERE SG_UF_IES = 'NATION_2'""", cen=_CENSUS)
def _(t):
    regions = t.sql("""SELECT n_name AS state, CASE WHEN n_name = 'NATION_2' THEN 'nowhere' ELSE r_name END AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'NATION_4'""")
    return census.check_census_rows(cen(t), regions, CATEGORIES, ORGANIZATIONS)


@query("c04_check_unique", "SELECT initials, count(*) AS n FROM inst GROUP BY initials HAVING count(*) > 1")
def _(t):
    return checks.check_unique(t.inst, "initials")


@query("c05_check_distribution", """
SELECT coalesce(a.k, e.k) AS key, a.n AS actual, e.n AS expected
FROM (SELECT state AS k, count(*) AS n FROM inst GROUP BY state) a
FULL JOIN (SELECT n_name AS k, CAST(n_nationkey % 7 AS BIGINT) AS n FROM nation WHERE n_nationkey <> 9) e ON a.k = e.k
WHERE a.n IS DISTINCT FROM e.n""")
def _(t):
    expected = t.nation.filter("n_nationkey <> 9").select(F.col("n_name").alias("key"), (F.col("n_nationkey") % 7).alias("n"))
    return checks.check_distribution(t.inst, "state", expected)


@query("c06_check_set", """
SELECT CO_IES AS value, 'unexpected' AS side FROM cen WHERE SG_IES IS NULL AND CO_IES NOT IN (SELECT official_code FROM inst WHERE balance < 4000)
UNION ALL SELECT official_code, 'missing' FROM inst WHERE balance < 4000 AND official_code NOT IN (SELECT CO_IES FROM cen WHERE SG_IES IS NULL)""", cen=_CENSUS)
def _(t):
    fallback = census.fallback_codes(census.derive_institutions(cen(t), CATEGORIES, ORGANIZATIONS))
    return checks.check_set(fallback, t.inst.filter("balance < 4000").select("official_code"))


# Source documents with the wrong JSON types on purpose, one defect set per part type.
_SOURCE_JSON = r"""
'{"catalog_source_id":"src-' || CAST(p_partkey AS STRING) || '",' || CASE WHEN p_type = 'LARGE' THEN '' ELSE '"name":"' || p_name || '",' END
|| '"url":"' || CASE WHEN p_type = 'MEDIUM' THEN 'ftp://x.org/' WHEN p_size % 2 = 0 THEN 'https://Seleção.org:443/' || CAST(p_partkey AS STRING) || '/' ELSE 'https://H.org:443/' || CAST(p_partkey AS STRING) || '/' END
|| '","source_type":"a","content_type":' || CASE WHEN p_type = 'LARGE' THEN '7' ELSE '" t "' END
|| ',"recommended_spider":"' || CASE WHEN p_type = 'ECONOMY' THEN 'bad' ELSE 'sigaa' END
|| '","status":"' || CASE WHEN p_type = 'PROMO' THEN 'weird' ELSE 'partial' END
|| '","is_active":' || CASE WHEN p_type = 'ECONOMY' THEN 'null' ELSE 'true' END
|| ',"http_status":' || CASE WHEN p_type = 'MEDIUM' THEN '700' WHEN p_type = 'STANDARD' THEN 'null' ELSE '200' END
|| ',"priority":' || CASE p_type WHEN 'STANDARD' THEN CAST(p_size AS STRING) WHEN 'MEDIUM' THEN '"2"' WHEN 'ECONOMY' THEN 'true'
     WHEN 'PROMO' THEN 'null' WHEN 'SMALL' THEN '2.5' ELSE '2' END
|| ',"redirect_chain":' || CASE p_type WHEN 'PROMO' THEN '["https://a.b/","https://a.b/"]' WHEN 'LARGE' THEN '["nope"]' WHEN 'STANDARD' THEN '["https://Ünï.example/x/","https://b.example"]' ELSE '[]' END
|| ',"categories":' || CASE p_type WHEN 'SMALL' THEN '"text"' WHEN 'LARGE' THEN '["a",1," "]' WHEN 'MEDIUM' THEN '5' ELSE '["a","b"]' END
|| ',"replaces":' || CASE p_type WHEN 'SMALL' THEN '["http://Ã.b/","HTTP://XN--3CA.B"]' WHEN 'ECONOMY' THEN '["old","https://Câmara.example/"]' ELSE 'null' END
|| CASE WHEN p_type = 'LARGE' THEN ',"final_url":""' ELSE '' END
|| ',"page_title":' || CASE WHEN p_type = 'SMALL' THEN '5' ELSE 'null' END || '}'
"""


def source_docs(t):
    return t.part.select(
        F.col("p_brand").alias("official_code"), F.col("p_partkey").alias("source_pos"),
        F.parse_json(F.expr(_SOURCE_JSON)).alias("source"),
    )


_DEFECTS = {
    "MEDIUM": [("url", "invalid"), ("http_status", "invalid"), ("priority", "invalid"), ("categories", "not_a_list")],
    "ECONOMY": [("recommended_spider", "unsupported"), ("is_active", "not_boolean"), ("priority", "invalid")],
    "PROMO": [("status", "unsupported"), ("priority", "invalid"), ("redirect_chain", "duplicate")],
    "SMALL": [("priority", "invalid"), ("replaces", "duplicate_normalized"), ("page_title", "not_text")],
    "LARGE": [("name", "required"), ("content_type", "required"), ("redirect_chain", "invalid_url"),
              ("categories", "empty_item"), ("final_url", "invalid")],
}


@query("c07_check_sources", " UNION ALL ".join(
    [f"SELECT p_brand AS official_code, p_partkey AS source_pos, '{f}' AS field, '{r}' AS rule FROM part WHERE p_type = '{k}'"
     for k, rows in _DEFECTS.items() for f, r in rows]
    + ["SELECT p_brand, p_partkey, 'priority', 'invalid' FROM part WHERE p_type = 'STANDARD' AND NOT p_size BETWEEN 1 AND 3"]))
def _(t):
    return catalog.check_sources(source_docs(t))


@query("c07_typed_sources", """
SELECT p_partkey AS source_pos, 'src-' || CAST(p_partkey AS VARCHAR) AS catalog_source_id,
  CASE WHEN p_type <> 'MEDIUM' THEN CASE WHEN p_size % 2 = 0 THEN 'https://xn--seleo-dra1a.org/' ELSE 'https://h.org/' END || CAST(p_partkey AS VARCHAR) END AS url,
  CASE WHEN p_type <> 'LARGE' THEN 't' END AS content_type, p_type <> 'ECONOMY' AS is_active,
  CASE p_type WHEN 'STANDARD' THEN NULL WHEN 'MEDIUM' THEN 700 ELSE 200 END AS http_status,
  CASE p_type WHEN 'STANDARD' THEN CAST(p_size AS INTEGER) WHEN 'LARGE' THEN 2 END AS priority,
  CASE p_type WHEN 'SMALL' THEN 'text' WHEN 'LARGE' THEN 'a,' WHEN 'MEDIUM' THEN '' ELSE 'a,b' END AS categories,
  CASE p_type WHEN 'STANDARD' THEN 'https://xn--n-nga1b.example/x,https://b.example' WHEN 'PROMO' THEN 'https://a.b,https://a.b' ELSE '' END AS redirect_chain,
  CASE p_type WHEN 'SMALL' THEN 'http://xn--3ca.b,http://xn--3ca.b' WHEN 'ECONOMY' THEN 'old,https://xn--cmara-3qa.example' ELSE '' END AS replaces
FROM part""")
def _(t):
    lists = [F.array_join(c, ",").alias(c) for c in ("categories", "redirect_chain", "replaces")]
    return catalog.typed_sources(source_docs(t)).select(
        "source_pos", "catalog_source_id", "url", "content_type", "is_active", "http_status", "priority", *lists)


_ENTRY_JSON = r"""
'{"official_code":' || CASE WHEN state = 'NATION_1' THEN CAST(id AS STRING) WHEN state = 'NATION_5' THEN '"9999999"' ELSE '"' || official_code || '"' END
|| ',"official_site_url":' || CASE WHEN state = 'NATION_6' THEN '"nope"' WHEN state = 'NATION_9' THEN '"HTTPS://Sítio.org/"' ELSE '"HTTPS://Site.org/"' END
|| ',"coverage_status":' || CASE WHEN state = 'NATION_7' THEN 'null' ELSE '"' || source_discovery_status || '"' END
|| ',"coverage_notes":' || CASE WHEN balance > 5000 THEN '" n "' WHEN state = 'NATION_8' THEN '1' ELSE 'null' END
|| CASE WHEN region = 'ASIA' THEN ',"eligibility_status":"excluded_x","eligibility_reason":" r "' WHEN state = 'NATION_10' THEN ',"eligibility_status":"maybe"' ELSE '' END
|| ',"sources":' || CASE WHEN state = 'NATION_11' THEN '{}' ELSE '[]' END || '}'
"""


def entry_docs(t):
    return t.inst.select("region", "id", F.parse_json(F.expr(_ENTRY_JSON)).alias("entry"))


def base_codes(t):
    moved = F.when(F.col("state") == "NATION_2", "moved").otherwise(F.col("region"))
    return t.inst.select("official_code", moved.alias("region"))


_KNOWN = "CASE WHEN state = 'NATION_1' THEN NULL WHEN state = 'NATION_5' THEN '9999999' ELSE official_code END"


@query("c08_check_entries", f"""
SELECT region, {_KNOWN} AS official_code, 'official_code' AS field, 'not_numeric' AS rule FROM inst WHERE state = 'NATION_1'
UNION ALL SELECT region, {_KNOWN}, 'official_code', 'unknown' FROM inst WHERE state IN ('NATION_1', 'NATION_5')
UNION ALL SELECT region, {_KNOWN}, 'official_code', 'wrong_region' FROM inst WHERE state = 'NATION_2'
UNION ALL SELECT region, {_KNOWN}, 'official_site_url', 'invalid' FROM inst WHERE state = 'NATION_6'
UNION ALL SELECT region, {_KNOWN}, 'coverage_status', 'unsupported' FROM inst WHERE state = 'NATION_7'
UNION ALL SELECT region, {_KNOWN}, 'coverage_notes', 'not_text' FROM inst WHERE state = 'NATION_8' AND balance <= 5000
UNION ALL SELECT region, {_KNOWN}, 'eligibility_status', 'unsupported' FROM inst WHERE state = 'NATION_10' AND region <> 'ASIA'
UNION ALL SELECT region, {_KNOWN}, 'sources', 'not_a_list' FROM inst WHERE state = 'NATION_11'""")
def _(t):
    return catalog.check_entries(entry_docs(t), base_codes(t))


@query("c09_check_keys", """
SELECT 'catalog_source_id' AS key, p_name AS value, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'official_code', initials, count(*) FROM inst GROUP BY initials HAVING count(*) > 1
UNION ALL SELECT 'source_url', p_brand || ' ' || p_type, count(*) FROM part GROUP BY p_brand, p_type HAVING count(*) > 1""")
def _(t):
    sources = t.part.select(F.col("p_name").alias("catalog_source_id"), F.col("p_brand").alias("official_code"), F.col("p_type").alias("url"))
    return catalog.check_keys(t.inst.select(F.col("initials").alias("official_code")), sources)


@query("c10_reconcile_codes", """
SELECT official_code, 'missing' AS side FROM inst WHERE balance < 2000
UNION ALL SELECT 'X' || official_code, 'extra' FROM inst WHERE balance > 8000""")
def _(t):
    kept = t.inst.filter("balance >= 2000").select("official_code")
    extra = t.inst.filter("balance > 8000").select(F.concat(F.lit("X"), "official_code").alias("official_code"))
    return catalog.reconcile_codes(t.inst, kept.unionByName(extra))


@query("c11_merge_catalog", """
SELECT official_code, CASE WHEN region = 'ASIA' THEN 'excluded_x' WHEN state = 'NATION_10' THEN 'maybe' ELSE eligibility_status END AS eligibility_status,
  CASE WHEN region = 'ASIA' THEN 'r' END AS eligibility_reason,
  CASE WHEN state = 'NATION_6' THEN NULL WHEN state = 'NATION_9' THEN 'https://xn--stio-vpa.org' ELSE 'https://site.org' END AS official_site_url,
  CASE WHEN state = 'NATION_7' THEN NULL ELSE source_discovery_status END AS coverage_status,
  CASE WHEN balance > 5000 THEN 'n' END AS coverage_notes
FROM inst WHERE state NOT IN ('NATION_1', 'NATION_5')""")
def _(t):
    base = t.inst.select("official_code", "eligibility_status", F.lit(None).cast("string").alias("eligibility_reason"))
    merged = catalog.merge_catalog(base, catalog.typed_entries(entry_docs(t)))
    return merged.select("official_code", "eligibility_status", "eligibility_reason", "official_site_url", "coverage_status", "coverage_notes")


_OVERLAY_JSON = r"""
'{"official_code":"' || CASE WHEN state = 'NATION_1' THEN '' ELSE 'LAW-' END || initials || '","official_code_origin":"'
|| CASE WHEN balance < 2000 THEN 'census' ELSE 'post_census_law' END || '","inventory_source_url":"' || CASE WHEN state = 'NATION_3' THEN 'https://Câmara.example/lei' ELSE official_site_url END
|| '","official_site_url":null,"coverage_status":"' || source_discovery_status || '","eligibility_status":"' || eligibility_status
|| '","sources":' || CASE WHEN balance > 9000 THEN '[1]' ELSE '[]' END || '}'
"""
_LAW = "CASE WHEN state = 'NATION_1' THEN '' ELSE 'LAW-' END || initials"


@query("c12_check_overlay", f"""
SELECT {_LAW} AS official_code, 'official_code' AS field, 'prefix' AS rule FROM inst WHERE state = 'NATION_1'
UNION ALL SELECT {_LAW}, 'official_code_origin', 'unexpected' FROM inst WHERE balance < 2000
UNION ALL SELECT {_LAW}, 'eligibility_status', 'not_included' FROM inst WHERE NOT starts_with(eligibility_status, 'included')
UNION ALL SELECT {_LAW}, 'sources', 'not_empty' FROM inst WHERE balance > 9000
UNION ALL SELECT {_LAW}, 'official_code', 'duplicate' FROM inst GROUP BY {_LAW} HAVING count(*) > 1
UNION ALL SELECT NULL, 'institutions', 'total' WHERE (SELECT count(*) FROM inst) <> 3""")
def _(t):
    overlay = t.inst.select(F.parse_json(F.expr(_OVERLAY_JSON)).alias("entry"))
    return catalog.check_overlay(overlay, 3)


def halves(t):
    late = F.col("official_code_origin") == "post_census_law"
    return t.cat.filter(~late), t.cat.filter(late).withColumn("official_code", F.concat(F.lit("LAW-"), "official_code"))


_HALVES = """
SELECT count(*) FILTER (WHERE NOT law) AS raw_total, count(*) FILTER (WHERE NOT law AND ok) AS eligible_census_total,
  count(*) FILTER (WHERE law) AS post_census_total, count(*) FILTER (WHERE ok) AS coverage_target_total,
  count(*) AS inventory_total, count(*) FILTER (WHERE sel) AS selected_inventory_total,
  count(*) FILTER (WHERE sel AND ok) AS selected_coverage_target_total
FROM (SELECT official_code_origin = 'post_census_law' AS law, starts_with(eligibility_status, 'included') AS ok, region IN ('ASIA', 'EUROPE') AS sel FROM cat)"""
_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def metadata(t):
    first, late = halves(t)
    return catalog.catalog_metadata(first, late, catalog.select_catalog(first, late, ["ASIA", "EUROPE"], known=_REGIONS))


@query("c13_check_totals", """
SELECT name, actual, expected FROM (
  SELECT 'raw_total' AS name, raw_total AS actual, CAST(317 AS BIGINT) AS expected FROM md
  UNION ALL SELECT 'eligible_census_total', eligible_census_total, 315 FROM md
  UNION ALL SELECT 'post_census_total', post_census_total, 3 FROM md
  UNION ALL SELECT 'coverage_target_total', coverage_target_total, 318 FROM md) WHERE actual <> expected""", md=_HALVES)
def _(t):
    return checks.check_totals(metadata(t), catalog.EXPECTED_TOTALS)


@query("c14_select_catalog", """
SELECT region, state, CASE WHEN official_code_origin = 'post_census_law' THEN 'LAW-' ELSE '' END || official_code AS official_code
FROM cat WHERE region IN ('ASIA', 'EUROPE')""")
def _(t):
    first, late = halves(t)
    return catalog.select_catalog(first, late, ["ASIA", "EUROPE"], known=_REGIONS).select("region", "state", "official_code")


@query("c15_catalog_metadata", _HALVES)
def _(t):
    return metadata(t)


# ---------------------------------------------------------------- legacy manifest

# Legacy rows: by initials, by name, and some that match nothing or a second row.
_LEGACY = """
SELECT id AS legacy_id, CASE WHEN balance < 5000 THEN name ELSE 'Ínst ' || CAST(id AS STRING) END AS name,
  CASE WHEN balance < 3000 THEN 'zz' ELSE lower(initials) END AS initials, ' ' || lower(state) || ' ' AS state, official_site_url,
  official_code AS true_code FROM inst WHERE balance >= 1000"""
_LEGACY_HITS = """
SELECT legacy_id, candidates, CASE WHEN candidates = 1 THEN code END AS official_code FROM (
  SELECT l.legacy_id, count(DISTINCT i.official_code) AS candidates, min(i.official_code) AS code FROM leg l
  LEFT JOIN inst i ON upper(trim(l.state)) = upper(i.state) AND (
    (l.initials = lower(i.initials)) OR lower(regexp_replace(l.name, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(i.name, '[^A-Za-z0-9]', '', 'g')))
  GROUP BY l.legacy_id)"""


def legacy_rows(t):
    return t.sql(_LEGACY)


def legacy_matches(t):
    rows = legacy_rows(t)
    index = t.inst.select("official_code", "official_name", "initials", "state", F.lit(None).cast("string").alias("official_initials"))
    return legacy.match_legacy(rows, index)


@query("c16_match_legacy", """
SELECT legacy_id, candidates, official_code, CASE WHEN candidates <> 1 THEN 'not_exactly_one'
  WHEN count(*) OVER (PARTITION BY official_code) > 1 THEN 'shared_code' END AS conflict FROM hit""", leg=_LEGACY, hit=_LEGACY_HITS)
def _(t):
    return legacy_matches(t)


_LEGACY_SOURCES = f"""
SELECT official_code, 'inep-' || official_code || '-' || {_SLUG.format(x='nm')} || '-' || substr(sha256(u), 1, 10) AS catalog_source_id,
  nm AS name, u AS url, source_type, replace(source_type, '_', ' ') AS content_type,
  CASE WHEN contains(lower(u), 'sigaa') THEN 'sigaa' ELSE 'generic' END AS recommended_spider, 2 AS priority,
  'https://xn--antigo-7ta.example/' || CAST(id AS VARCHAR) || '|old ' || CAST(id AS VARCHAR) AS replaces
FROM (SELECT id, CAST(institution_id AS VARCHAR) AS official_code, CASE WHEN priority_size < 10 THEN 'Fonte legada ' || CAST(id + 1 AS VARCHAR) ELSE name END AS nm,
  CASE WHEN priority_size % 3 = 0 THEN replace(url, 'https://', 'https://xn--so-sia.') ELSE url END AS u, source_type FROM src)"""


def legacy_sources(t):
    old = F.concat(F.lit("https://ANTIGÃO.example/"), F.col("id").cast("string"), F.lit("/"))
    raw = t.src.select(
        F.col("institution_id").cast("string").alias("official_code"), F.col("id").alias("index"),
        F.when(F.col("priority_size") < 10, F.lit(" ")).otherwise(F.col("name")).alias("name"),
        F.concat(F.when(F.col("priority_size") % 3 == 0, F.replace("url", F.lit("https://"), F.lit("https://São."))).otherwise(F.col("url")),
                 F.lit("/#top")).alias("url"), "source_type",
        F.array(old, F.lit(" "), F.concat(F.lit("old  "), F.col("id").cast("string")), old).alias("replaces"),
    )
    return legacy.derive_legacy_sources(raw)


@query("c17_derive_legacy_sources", _LEGACY_SOURCES)
def _(t):
    return legacy_sources(t).select("official_code", "catalog_source_id", "name", "url", "source_type", "content_type",
                                    "recommended_spider", "priority", F.array_join("replaces", "|").alias("replaces"))


_CORRECTED = "SELECT official_code FROM inst WHERE state IN ('NATION_1', 'NATION_8', 'NATION_20')"


def corrections(t):
    chosen = t.sql(_CORRECTED)
    rows = chosen.select("official_code", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("x"))
    return rows.select(
        "official_code", F.concat(F.lit("inep-"), "official_code", F.lit("-new-"), "x").alias("catalog_source_id"),
        F.lit("Researched").alias("name"), F.concat(F.lit("https://new.example/"), "x").alias("url"),
        F.array(F.lit("given")).alias("replaces"),
    )


def corrected_sources(t):
    mine = legacy_sources(t).select("official_code", "catalog_source_id", "name", "url", "replaces")
    return mine, legacy.apply_corrections(mine, corrections(t))


_CORRECTED_ROWS = """
SELECT official_code, catalog_source_id, url FROM lsr WHERE official_code NOT IN (SELECT official_code FROM cor)
UNION ALL SELECT official_code, 'inep-' || official_code || '-new-a', 'https://new.example/a' FROM cor
UNION ALL SELECT official_code, 'inep-' || official_code || '-new-b', 'https://new.example/b' FROM cor"""


@query("c18_apply_corrections", _CORRECTED_ROWS, lsr=_LEGACY_SOURCES, cor=_CORRECTED)
def _(t):
    return corrected_sources(t)[1].select("official_code", "catalog_source_id", "url")


@query("c18_replacement_rules", """
SELECT official_code, 'inep-' || official_code || '-new-a' AS catalog_source_id, catalog_source_id AS from_source, CAST(x.p AS INTEGER) AS position,
  CASE x.p WHEN 0 THEN catalog_source_id WHEN 1 THEN url WHEN 2 THEN string_split(replaces, '|')[1] ELSE string_split(replaces, '|')[2] END AS value
FROM lsr, (VALUES (0), (1), (2), (3)) x(p) WHERE official_code IN (SELECT official_code FROM cor)""", lsr=_LEGACY_SOURCES, cor=_CORRECTED)
def _(t):
    return legacy.replacement_rules(corrected_sources(t)[0], corrections(t))


# The census and a branch of every late institution; branches have neither legacy rows nor sources.
_ALL_CODES = """SELECT official_code, state, balance, official_site_url FROM inst
UNION ALL SELECT 'LAW-' || official_code, state, CAST(NULL AS DOUBLE), CAST(NULL AS STRING) FROM inst WHERE official_code_origin = 'post_census_law'"""


@query("c19_assemble_manifest", """
SELECT a.official_code, CASE WHEN balance >= 1000 THEN CASE WHEN state = 'NATION_4' THEN 'https://xn--cmara-3qa.example' ELSE a.official_site_url END END AS official_site_url,
  CASE WHEN s.n IS NULL THEN 'source_not_found' ELSE 'partial' END AS coverage_status, coalesce(s.n, 0) AS source_count
FROM aci a LEFT JOIN (SELECT official_code, count(*) AS n FROM crt GROUP BY official_code) s ON s.official_code = a.official_code""",
       lsr=_LEGACY_SOURCES, cor=_CORRECTED, crt=_CORRECTED_ROWS, aci=_ALL_CODES)
def _(t):
    site = F.when(F.ltrim("state") == "nation_4 ", "https://CÂMARA.example:443").otherwise(F.col("official_site_url"))
    matched = legacy_rows(t).select(F.col("true_code").alias("official_code"), F.concat(site, F.lit("/")).alias("official_site_url"))
    return legacy.assemble_manifest(t.sql(_ALL_CODES), matched, corrected_sources(t)[1]).drop("coverage_notes")


@query("c19_manifest_counts", """
SELECT (SELECT count(*) FROM aci) AS institutions, count(DISTINCT official_code) AS partial,
  (SELECT count(*) FROM aci) - count(DISTINCT official_code) AS source_not_found, count(*) AS sources FROM crt""",
       lsr=_LEGACY_SOURCES, cor=_CORRECTED, crt=_CORRECTED_ROWS, aci=_ALL_CODES)
def _(t):
    matched = legacy_rows(t).select(F.col("true_code").alias("official_code"), "official_site_url")
    return legacy.manifest_counts(legacy.assemble_manifest(t.sql(_ALL_CODES), matched, corrected_sources(t)[1]))


# ---------------------------------------------------------------- merge into the registry


@query("e01_split_eligible", """
SELECT count(*) FILTER (WHERE NOT ok) AS ignored, count(*) FILTER (WHERE ok AND coverage_status <> 'verified') AS pending,
  count(*) FILTER (WHERE ok AND coverage_status = 'manual_review') AS manual_review
FROM (SELECT *, starts_with(eligibility_status, 'included') AS ok FROM cat)""")
def _(t):
    return upsert.split_eligible(t.cat)[1]


_ELIGIBLE = "SELECT * FROM cat WHERE starts_with(eligibility_status, 'included')"


@query("e02_key_counts", """
SELECT 'initials' AS kind, lower(initials) AS initials, state, NULL AS name, count(*) AS n FROM elg GROUP BY initials, state HAVING count(*) > 1
UNION ALL SELECT 'identity', lower(initials), state, 'same', count(*) FROM elg GROUP BY initials, state HAVING count(*) > 2""", elg=_ELIGIBLE)
def _(t):
    eligible = upsert.split_eligible(t.cat)[0]
    # Official initials that repeat: the third tier of keys must notice them.
    by_initials = upsert.key_counts(eligible).filter("kind = 'initials'")
    same_names = upsert.key_counts(eligible.withColumn("official_name", F.lit("Sáme"))).filter("kind = 'identity' AND n > 2")
    return by_initials.unionByName(same_names)


# Set-based tiers: code, then identity, then initials, each unique on both sides.
_RESOLVED = """
SELECT e.official_code, r.id, 1 AS tier FROM elg e JOIN reg r ON r.official_code = e.official_code
UNION ALL SELECT official_code, id, 2 FROM idn WHERE total = 1 AND found = 1
UNION ALL SELECT official_code, id, 3 FROM ini WHERE total = 1 AND found = 1"""
_IDENTITY = """
SELECT e.official_code, r.id, count(*) OVER (PARTITION BY e.official_code) AS found,
  (SELECT count(*) FROM elg x WHERE x.initials = e.initials AND x.state = e.state AND x.official_name = e.official_name) AS total
FROM elg e JOIN reg r ON r.official_code IS NULL AND r.initials = e.initials AND r.state = e.state AND r.name = e.official_name
WHERE e.official_code NOT IN (SELECT official_code FROM reg WHERE official_code IS NOT NULL)"""
_INITIALS = """
SELECT e.official_code, r.id, count(*) OVER (PARTITION BY e.official_code) AS found,
  (SELECT count(*) FROM elg x WHERE x.initials = e.initials AND x.state = e.state) AS total
FROM elg e JOIN reg r ON r.official_code IS NULL AND r.initials = e.initials AND r.state = e.state
WHERE e.official_code NOT IN (SELECT official_code FROM reg WHERE official_code IS NOT NULL)
  AND e.official_code NOT IN (SELECT official_code FROM idn) AND r.id NOT IN (SELECT id FROM idn WHERE total = 1 AND found = 1)"""
_TIERS = {"elg": _ELIGIBLE, "idn": _IDENTITY, "ini": _INITIALS, "rsv": _RESOLVED}


def resolved(t):
    eligible = upsert.split_eligible(t.cat)[0]
    return eligible, *upsert.resolve_institutions(eligible, t.reg)


@query("e03_resolve_institutions", "SELECT official_code, id, tier FROM rsv", **_TIERS)
def _(t):
    return resolved(t)[1]


# The same tiers with the region as state, where initials collide.
_COARSE = {
    "elg": "SELECT * REPLACE (region AS state) FROM cat WHERE starts_with(eligibility_status, 'included')",
    "rg4": "SELECT * REPLACE (region AS state) FROM reg",
    "idn": _IDENTITY.replace(" reg ", " rg4 "),
    "ini": _INITIALS.replace(" reg ", " rg4 "),
}


@query("e04_resolution_conflicts", """
SELECT official_code, CASE WHEN max(total) > 1 THEN 'ambiguous_in_catalog' ELSE 'ambiguous_in_registry' END AS rule
FROM ini WHERE total > 1 OR found > 1 GROUP BY official_code""", **_COARSE)
def _(t):
    by_region = lambda df: df.withColumn("state", F.col("region"))
    eligible = upsert.split_eligible(by_region(t.cat))[0]
    registry = by_region(t.reg)
    _m, conflicts = upsert.resolve_institutions(eligible, registry)
    # A conflict names its key; every waiting row of the key is concerned.
    keys = upsert.catalog_keys(eligible).select("official_code", F.concat_ws("/", "_i", "_s").alias("value"))
    coded = registry.filter("official_code is not null").select("official_code")
    waiting = keys.join(coded, "official_code", "left_anti").join(_m, "official_code", "left_anti")
    return waiting.join(conflicts.select("value", "rule"), "value").select("official_code", "rule")


_UPSERTED = """
SELECT coalesce(r.name, e.official_name) AS name, coalesce(r.initials, e.initials) AS initials,
  CASE WHEN e.official_code IS NOT NULL THEN e.official_code ELSE r.official_code END AS official_code,
  CASE WHEN r.id IS NULL OR (e.official_code IS NOT NULL AND r.official_site_url IS NULL) THEN e.official_site_url ELSE r.official_site_url END AS official_site_url,
  CASE WHEN e.official_code IS NOT NULL THEN e.coverage_status ELSE r.source_discovery_status END AS source_discovery_status,
  CASE WHEN r.id IS NOT NULL THEN r.is_active ELSE e.current_situation <> 'created_pending_implementation' END AS is_active,
  CASE WHEN e.official_code IS NULL THEN NULL WHEN r.id IS NULL THEN 'created'
    WHEN r.official_code IS DISTINCT FROM e.official_code OR r.source_discovery_status IS DISTINCT FROM e.coverage_status
      OR r.eligibility_status IS DISTINCT FROM e.eligibility_status OR r.official_site_url IS NULL THEN 'updated' ELSE 'ignored' END AS action
FROM (SELECT elg.*, rsv.id AS rid FROM elg LEFT JOIN rsv ON rsv.official_code = elg.official_code) e
FULL JOIN reg r ON r.id = e.rid"""


@query("e05_upsert_institutions", _UPSERTED, **_TIERS)
def _(t):
    eligible, matches, _c = resolved(t)
    merged = upsert.upsert_institutions(eligible, t.reg, matches)
    return merged.select("name", "initials", "official_code", "official_site_url", "source_discovery_status", "is_active", "action")


@query("e06_diff_rows", """
SELECT c.official_code, CASE WHEN r.official_code IS NULL THEN 'created' WHEN r.source_discovery_notes IS DISTINCT FROM c.coverage_notes
  OR r.source_discovery_status IS DISTINCT FROM c.coverage_status THEN 'updated' ELSE 'ignored' END AS action
FROM cat c LEFT JOIN reg r ON r.official_code = c.official_code""")
def _(t):
    old = t.reg.filter("official_code is not null").select(
        "official_code", F.col("source_discovery_notes").alias("notes"), F.col("source_discovery_status").alias("status"))
    new = t.cat.select("official_code", F.col("coverage_notes").alias("notes"), F.col("coverage_status").alias("status"))
    return upsert.diff_rows(old, new, "official_code", ["notes", "status"])


def owned_sources(t, settled=False):
    """Catalog sources of institutions that exist in the registry under their offset id.

    LARGE sources meet rows that another catalog id owns; ``settled`` lets them name that id.
    """
    owner = F.concat(F.lit("other-"), F.col("p_partkey").cast("string"))
    given = F.when(F.col("p_type") == "LARGE", owner).otherwise(F.col("replaced")) if settled else F.col("replaced")
    return t.csr.withColumn("institution_id", F.col("official_code").cast("long") + 100000).withColumn(
        "replaces", F.when(given.isNotNull(), F.array(given)).otherwise(F.array().cast("array<string>"))).drop("replaced")


def resolved_sources(t, settled=False):
    """``owned_sources`` with their matches and conflicts."""
    mine = owned_sources(t, settled)
    return mine, *upsert.resolve_sources(mine, t.rsr)


@query("e07_resolve_sources", """
SELECT catalog_source_id, rsr.id, csr.p_type IN ('MEDIUM', 'PROMO', 'SMALL') AS replaced
FROM csr JOIN rsr ON rsr.id = csr.p_partkey + 500000 WHERE csr.p_type <> 'LARGE'""".replace("SELECT catalog_source_id", "SELECT csr.catalog_source_id"))
def _(t):
    return resolved_sources(t)[1]


@query("e08_source_conflicts", """
SELECT csr.catalog_source_id, 'url_owned_by_other_id' AS rule FROM csr JOIN rsr ON rsr.id = csr.p_partkey + 500000 WHERE csr.p_type = 'LARGE'
UNION ALL SELECT csr.catalog_source_id, 'id_of_other_institution' FROM csr JOIN rsr ON rsr.id = csr.p_partkey + 500000 WHERE csr.p_type = 'STANDARD' AND csr.priority = 3""")
def _(t):
    mine = owned_sources(t)
    moved = mine.withColumn("institution_id", F.when(
        (F.col("p_type") == "STANDARD") & (F.col("priority") == 3), -1).otherwise(F.col("institution_id")))
    return upsert.resolve_sources(moved, t.rsr)[1]


# The whole source table after the merge; LARGE rows are not matched, so both sides stay.
_SOURCE_ACTIONS = """
SELECT CASE WHEN c.p_partkey IS NULL THEN r.catalog_source_id ELSE c.catalog_source_id END AS catalog_source_id, coalesce(r.is_active, false) AS is_active,
  r.last_error_message, CASE WHEN c.p_partkey IS NULL THEN r.normalized_url ELSE c.url END AS normalized_url,
  CASE WHEN c.p_partkey IS NULL THEN NULL WHEN r.id IS NULL THEN 'created'
    WHEN c.p_type <> 'STANDARD' OR r.coverage_status IS DISTINCT FROM c.status THEN 'updated' ELSE 'ignored' END AS action,
  r.id IS NOT NULL AND coalesce(c.p_type IN ('MEDIUM', 'PROMO', 'SMALL'), false) AS replaced
FROM (SELECT *, CASE WHEN p_type <> 'LARGE' THEN p_partkey + 500000 END AS rid FROM csr) c FULL JOIN rsr r ON r.id = c.rid"""


@query("e09_upsert_sources", _SOURCE_ACTIONS)
def _(t):
    mine, matches, _c = resolved_sources(t)
    return upsert.upsert_sources(mine, t.rsr, matches).select("catalog_source_id", "is_active", "last_error_message", "normalized_url", "action", "replaced")


@query("e10_upsert_stats", """
SELECT i.created + s.created AS created, i.updated + s.updated AS updated, i.ignored + x.ignored + s.ignored AS ignored, s.replaced,
  i.created AS institutions_created, i.updated AS institutions_updated, i.ignored + x.ignored AS institutions_ignored,
  s.created AS sources_created, s.updated AS sources_updated, s.ignored AS sources_ignored, s.replaced AS sources_replaced, x.pending, x.manual_review
FROM (SELECT count(*) FILTER (WHERE action = 'created') AS created, count(*) FILTER (WHERE action = 'updated') AS updated,
        count(*) FILTER (WHERE action = 'ignored') AS ignored FROM ups) i,
  (SELECT count(*) FILTER (WHERE action = 'created') AS created, count(*) FILTER (WHERE action = 'updated') AS updated,
        count(*) FILTER (WHERE action = 'ignored') AS ignored, count(*) FILTER (WHERE replaced) AS replaced FROM sac) s,
  (SELECT count(*) FILTER (WHERE NOT ok) AS ignored, count(*) FILTER (WHERE ok AND coverage_status <> 'verified') AS pending,
        count(*) FILTER (WHERE ok AND coverage_status = 'manual_review') AS manual_review
   FROM (SELECT *, starts_with(eligibility_status, 'included') AS ok FROM cat)) x""", **_TIERS, ups=_UPSERTED, sac=_SOURCE_ACTIONS)
def _(t):
    eligible, matches, _c = resolved(t)
    mine, source_matches, _d = resolved_sources(t)
    return upsert.upsert_stats(
        upsert.upsert_institutions(eligible, t.reg, matches),
        upsert.upsert_sources(mine, t.rsr, source_matches),
        upsert.split_eligible(t.cat)[1],
    )


_PUBLISHED = """
SELECT 'refused' AS state, 'institution' AS kind, name AS label, official_code AS code, is_active FROM reg
UNION ALL SELECT 'refused', 'source', url, catalog_source_id, is_active FROM rsr
UNION ALL SELECT 'merged', 'institution', name, official_code, is_active FROM ups2
UNION ALL SELECT 'merged', 'source', CASE WHEN c.catalog_source_id IS NULL THEN r.url ELSE c.url END,
  coalesce(c.catalog_source_id, r.catalog_source_id), coalesce(r.is_active, false)
  FROM csr c FULL JOIN rsr r ON r.id = c.p_partkey + 500000"""


@query("e11_publish_upsert", _PUBLISHED, **_TIERS, ups2=_UPSERTED)
def _(t):
    root = scratch_path(t.spark, "registry")
    sinks.publish_set({"institutions": t.reg, "sources": t.rsr}, root)
    eligible, matches, _c = resolved(t)
    institutions = upsert.upsert_institutions(eligible, t.reg, matches)

    def contents(state):
        now = sinks.read_set(t.spark, root)
        return now["institutions"].select(
            F.lit(state).alias("state"), F.lit("institution").alias("kind"), F.col("name").alias("label"), F.col("official_code").alias("code"), "is_active"
        ).unionAll(now["sources"].select(F.lit(state), F.lit("source"), "url", "catalog_source_id", "is_active"))

    # all sources hold conflicts: the merge is refused as a whole and both tables stay
    every, all_matches, conflicts = resolved_sources(t)
    state = "accepted"
    try:
        upsert.publish_upsert(institutions, upsert.upsert_sources(every, t.rsr, all_matches), [conflicts], root)
    except checks.RuleViolation:
        state = "refused"
    before = contents(state)
    # with the owned ids named as replaced, the same catalog goes through
    mine, source_matches, settled = resolved_sources(t, settled=True)
    upsert.publish_upsert(institutions, upsert.upsert_sources(mine, t.rsr, source_matches), [settled], root)
    return before.unionAll(contents("merged"))


@query("e12_upsert_region", """
SELECT name, official_code, source_discovery_status, action FROM ups""", **_TIERS | {"elg": _ELIGIBLE + " AND region = 'ASIA'"}, ups=_UPSERTED)
def _(t):
    first, late = halves(t)
    late = late.withColumn("official_code", F.regexp_replace("official_code", "^LAW-", ""))
    eligible = upsert.split_eligible(catalog.select_catalog(first, late, "ASIA", known=_REGIONS))[0]
    matches, _c = upsert.resolve_institutions(eligible, t.reg)
    merged = upsert.upsert_institutions(eligible, t.reg, matches)
    return merged.select("name", "official_code", "source_discovery_status", "action")


@query("e13_backfill_legacy", """
SELECT 'institution' AS kind, id, coalesce(eligibility_status, 'included_legacy') AS a,
  CASE WHEN eligibility_status IS NULL THEN 'manual_review' ELSE source_discovery_status END AS b FROM reg
UNION ALL SELECT 'source', id, coalesce(normalized_url, url), CASE WHEN normalized_url IS NULL THEN 'manual_review' ELSE coverage_status END FROM rsr""")
def _(t):
    institutions, sources = upsert.backfill_legacy(t.reg, t.rsr)
    return institutions.select(F.lit("institution").alias("kind"), "id", F.col("eligibility_status").alias("a"), F.col("source_discovery_status").alias("b")).unionAll(
        sources.select(F.lit("source").alias("kind"), "id", F.col("normalized_url").alias("a"), F.col("coverage_status").alias("b")))
