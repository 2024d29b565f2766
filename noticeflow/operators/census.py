"""Census rows to catalog institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeflow.functions.text import squash
from noticeflow.lexicon import ACADEMIC_ORGANIZATIONS, ADMINISTRATIVE_CATEGORIES, REGION_BY_STATE
from noticeflow.operators.checks import violations

_DIGITS = r"^\p{Nd}+$"


def filter_census(census: DataFrame, year: str = "2024", network: str = "1") -> DataFrame:
    """Public institutions of one census year."""
    return census.filter(
        (squash(F.col("NU_ANO_CENSO")) == year) & (squash(F.col("TP_REDE")) == network)
    )


def state_regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGION_BY_STATE.items()), "state string, region string")


def _label(code: Column, labels: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(table, code)


def derive_institutions(
    census: DataFrame,
    categories: dict[int, str] = ADMINISTRATIVE_CATEGORIES,
    organizations: dict[int, str] = ACADEMIC_ORGANIZATIONS,
    *,
    inventory_source_url: str | None = None,
    inventory_reference_date: str | None = None,
) -> DataFrame:
    """Catalog fields of census rows; missing initials become a generated code."""
    code = squash(F.col("CO_IES"))
    official = F.nullif(squash(F.col("SG_IES")), F.lit(""))
    category = squash(F.col("TP_CATEGORIA_ADMINISTRATIVA")).try_cast("int")
    organization = squash(F.col("TP_ORGANIZACAO_ACADEMICA")).try_cast("int")
    return census.select(
        code.alias("official_code"),
        squash(F.col("NO_IES")).alias("official_name"),
        official.alias("official_initials"),
        F.coalesce(official, F.concat(F.lit("IES-"), code)).alias("initials"),
        F.when(official.isNotNull(), "official").otherwise("generated_fallback").alias("initials_origin"),
        squash(F.col("NO_REGIAO_IES")).alias("region"),
        F.upper(squash(F.col("SG_UF_IES"))).alias("state"),
        squash(F.col("NO_MUNICIPIO_IES")).alias("headquarters_city"),
        squash(F.col("CO_MUNICIPIO_IES")).alias("municipality_code"),
        category.alias("administrative_category_code"),
        _label(category, categories).alias("administrative_category_label"),
        organization.alias("academic_organization_code"),
        _label(organization, organizations).alias("academic_organization_label"),
        # State of a freshly counted institution.
        F.lit("included_in_census_2024").alias("census_situation"),
        F.lit("manual_review").alias("current_situation"),
        F.lit("included").alias("eligibility_status"),
        F.lit(None).cast("string").alias("eligibility_reason"),
        F.lit(None).cast("string").alias("official_site_url"),
        F.lit(inventory_source_url).cast("string").alias("inventory_source_url"),
        F.lit(inventory_reference_date).cast("string").alias("inventory_reference_date"),
    )


def check_census_rows(
    census: DataFrame,
    regions: DataFrame,
    categories: dict[int, str] = ADMINISTRATIVE_CATEGORIES,
    organizations: dict[int, str] = ACADEMIC_ORGANIZATIONS,
) -> DataFrame:
    """Broken row rules: official_code, field, rule.  ``regions``: state, region."""
    known = regions.select(F.col("state").alias("_state"), F.col("region").alias("_region"))
    joined = census.withColumn("_state", F.upper(squash(F.col("SG_UF_IES")))).join(known, "_state", "left")
    text = lambda c: squash(F.col(c))

    def in_codes(column: str, codes) -> list[tuple[str, str, Column]]:
        numeric = text(column).rlike(_DIGITS)
        return [
            (column, "not_numeric", ~numeric),
            (column, "unsupported", numeric & ~F.coalesce(text(column).try_cast("int").isin(list(codes)), F.lit(False))),
        ]

    rules = [
        ("CO_IES", "not_numeric", ~text("CO_IES").rlike(_DIGITS)),
        ("NO_IES", "empty", text("NO_IES") == ""),
        ("SG_UF_IES", "unknown_state", F.col("_region").isNull()),
        ("NO_REGIAO_IES", "wrong_region", F.col("_region").isNotNull() & (text("NO_REGIAO_IES") != F.col("_region"))),
        ("CO_MUNICIPIO_IES", "not_numeric", ~text("CO_MUNICIPIO_IES").rlike(_DIGITS)),
        ("NO_MUNICIPIO_IES", "empty", text("NO_MUNICIPIO_IES") == ""),
        *in_codes("TP_CATEGORIA_ADMINISTRATIVA", categories),
        *in_codes("TP_ORGANIZACAO_ACADEMICA", organizations),
    ]
    return violations(joined, [text("CO_IES").alias("official_code")], rules)


def fallback_codes(institutions: DataFrame) -> DataFrame:
    return institutions.filter("initials_origin = 'generated_fallback'").select("official_code")
