"""Regional manifest from the legacy seed: match, derive sources, correct, assemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeflow.functions.staging import stage
from noticeflow.functions.text import identity_token, squash, stable_source_id
from noticeflow.functions.urls import catalog_url, host_form, with_host_forms


def _tokens(*cols: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(F.array(*[identity_token(c) for c in cols]), "")))


def _token_keys(tokens: str) -> Column:
    """Every token, and every pair of tokens of one row in order: array<struct<a, b>>, b null for one."""
    nothing = F.lit(None).cast("string")
    single = F.transform(tokens, lambda a: F.struct(a.alias("a"), nothing.alias("b")))
    pairs = F.flatten(F.transform(tokens, lambda a: F.transform(
        F.filter(tokens, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.concat(single, pairs)


def match_legacy(legacy: DataFrame, census: DataFrame) -> DataFrame:
    """legacy_id, candidates, official_code (null unless exactly one), conflict.

    ``legacy``: legacy_id, name, initials, state; ``census``: official_code, names, state, one row
    each.  The index holds one certificate (count and least code) per token and per pair of
    tokens of a state; a legacy row has at most two tokens and counts both less their pair, so a
    token that many rows share never multiplies.
    """
    index = stage(census, _state=F.upper("state"), _tokens=_tokens(F.col("official_initials"), F.col("initials"), F.col("official_name")))
    held = index.select("official_code", "_state", F.inline(_token_keys("_tokens"))).groupBy(
        "_state", "a", F.coalesce("b", F.lit("")).alias("b")).agg(F.count("*").alias("_n"), F.min("official_code").alias("_code"))
    probe = stage(legacy, _state=F.upper(squash(F.col("state"))), _tokens=_tokens(F.col("initials"), F.col("name")))
    asked = probe.select("legacy_id", "_state", F.inline(_token_keys("_tokens"))).withColumn("b", F.coalesce("b", F.lit("")))
    one = F.col("b") == ""
    per_row = asked.join(held, ["_state", "a", "b"]).groupBy("legacy_id").agg(
        F.sum(F.when(one, F.col("_n")).otherwise(-F.col("_n"))).alias("candidates"), F.min(F.when(one, F.col("_code"))).alias("_code")
    )
    resolved = legacy.select("legacy_id").join(per_row, "legacy_id", "left").select(
        "legacy_id",
        F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
        F.when(F.col("candidates") == 1, F.col("_code")).alias("official_code"),
    )
    shared = resolved.filter("official_code is not null").groupBy("official_code").agg(
        F.count("*").alias("_rows")
    ).filter("_rows > 1")
    joined = resolved.join(shared, "official_code", "left")
    conflict = F.when(F.col("candidates") != 1, "not_exactly_one").when(F.col("_rows").isNotNull(), "shared_code")
    return joined.select("legacy_id", "candidates", "official_code", conflict.alias("conflict"))


# Provenance of a migrated source.
_EVIDENCE = "Migrada do seed Nordeste anterior; confirmação de domínio não equivale a verificação estrutural atual."
_NOTES = "Mantida como partial até auditoria HTTP e validação controlada de captura."
_MIGRATED = "Fontes migradas do seed regional e mantidas como partial até auditoria estrutural controlada."
_UNUSABLE = "Seed legado não continha fonte oficial utilizável."
_NOT_FOUND = "Instituição presente no inventário oficial, mas sem fonte oficial de editais localizada nesta rodada."


def derive_legacy_sources(sources: DataFrame) -> DataFrame:
    """Catalog sources of legacy ones: official_code, index, name, url, source_type, replaces in."""
    name = F.coalesce(
        F.nullif(squash(F.col("name")), F.lit("")),
        F.concat(F.lit("Fonte legada "), (F.col("index") + 1).cast("string")),
    )
    normal_url = lambda u: catalog_url(u, idna=host_form())["url"]
    old = F.coalesce("replaces", F.array().cast("array<string>"))
    sources = with_host_forms(sources, F.concat(F.array("url"), old))
    kind = F.coalesce(F.nullif(squash(F.col("source_type")), F.lit("")), F.lit("editais"))
    staged = sources.select("official_code", name.alias("name"), normal_url(F.col("url")).alias("url"),
                            kind.alias("source_type"), "replaces", "_hosts")
    normal = F.transform(
        F.filter(F.transform(old, squash), lambda v: v != ""),
        lambda v: F.when(v.rlike("(?i)^https?://"), normal_url(v)).otherwise(v),
    )
    return staged.select(
        "official_code",
        stable_source_id(F.col("official_code"), F.col("name"), F.col("url")).alias("catalog_source_id"),
        "name",
        "url",
        "source_type",
        F.replace("source_type", F.lit("_"), F.lit(" ")).alias("content_type"),
        F.when(F.lower("url").contains("sigaa"), "sigaa").otherwise("generic").alias("recommended_spider"),
        F.lit("partial").alias("status"),
        F.lit(_EVIDENCE).alias("verification_evidence"),
        F.lit(_NOTES).alias("verification_notes"),
        F.lit(2).alias("priority"),
        F.array("source_type").alias("categories"),
        F.lit(False).alias("is_active"),
        F.array_distinct(normal).alias("replaces"),
    )


def apply_corrections(sources: DataFrame, corrections: DataFrame) -> DataFrame:
    """Researched sources replace every legacy source of their institution."""
    corrected = corrections.select("official_code").distinct()
    kept = sources.join(corrected, "official_code", "left_anti")
    return kept.unionByName(corrections, allowMissingColumns=True)


def replacement_rules(sources: DataFrame, corrections: DataFrame) -> DataFrame:
    """What the first correction of an institution supersedes, one row per value.

    official_code, catalog_source_id (of the correction), value, from_source, position: ids,
    URLs and own replaces of the legacy sources, each value once at its first place.  Rows,
    not one list, so an institution with very many sources stays spread out.
    """
    lead = corrections.groupBy("official_code").agg(F.min("catalog_source_id").alias("_lead"))
    superseded = sources.join(lead, "official_code")
    values = superseded.select(
        "official_code", "_lead", F.col("catalog_source_id").alias("from_source"),
        F.posexplode(F.concat(F.array("catalog_source_id", "url"), "replaces")).alias("position", "value"),
    )
    first = values.groupBy("official_code", "_lead", "value").agg(
        F.min(F.struct("from_source", "position")).alias("_at")
    )
    return first.select("official_code", F.col("_lead").alias("catalog_source_id"), "value", "_at.*")


def assemble_manifest(census: DataFrame, matched: DataFrame, sources: DataFrame) -> DataFrame:
    """One manifest entry per census institution; sources stay a table beside it.

    ``matched``: official_code, official_site_url of institutions with a legacy row.
    """
    counts = sources.groupBy("official_code").agg(F.count("*").alias("source_count"))
    legacy = matched.select("official_code", "official_site_url", F.lit(True).alias("_legacy"))
    joined = census.select("official_code").join(legacy, "official_code", "left").join(counts, "official_code", "left")
    has = F.col("source_count").isNotNull()
    return joined.select(
        "official_code",
        catalog_url(F.col("official_site_url"))["url"].alias("official_site_url"),
        F.when(has, "partial").otherwise("source_not_found").alias("coverage_status"),
        F.when(has, _MIGRATED).when(F.col("_legacy"), _UNUSABLE).otherwise(_NOT_FOUND).alias("coverage_notes"),
        F.coalesce("source_count", F.lit(0)).cast("long").alias("source_count"),
    )


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("institutions"),
        F.count_if(F.col("coverage_status") == "partial").alias("partial"),
        F.count_if(F.col("coverage_status") == "source_not_found").alias("source_not_found"),
        F.coalesce(F.sum("source_count"), F.lit(0)).cast("long").alias("sources"),
    )
