"""Regional audit: probes, item validity, source verdicts, run comparison, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticeflow.functions import text, urls
from noticeflow.functions.staging import stage
from noticeflow.lexicon import AUDIT_KEYWORDS, AUDIT_LISTING_TITLES, LINK_DOCUMENT_SUFFIXES, NOTICE_TYPES
from noticeflow.operators.html import count_links
from noticeflow.session import materialize


def probe_pages(pages: DataFrame, keywords=AUDIT_KEYWORDS) -> DataFrame:
    """Probe metrics per page (page_id, url, html, status_code, content_type).

    opens, html_length, link_count, distinct keywords in the folded source, html_useful.
    """
    counts = count_links(pages)
    staged = stage(pages, _f=text.fold_text(F.col("html")))
    hits = sum((F.col("_f").contains(k).cast("int") for k in keywords), F.lit(0))
    is_html = F.lower(F.coalesce("content_type", F.lit(""))).contains("html") | F.col("html").rlike("(?i)<html")
    opens = F.coalesce(F.col("status_code") < 400, F.lit(False))
    # Numbers first: the join below moves no page text.
    numbers = staged.select(
        "page_id",
        "status_code",
        opens.alias("opens"),
        F.length("html").cast("long").alias("html_length"),
        hits.cast("long").alias("keyword_count"),
        is_html.alias("_is_html"),
    )
    joined = numbers.join(counts, "page_id")
    useful = F.col("opens") & F.col("_is_html") & (F.col("link_count") > 0)
    return joined.withColumn("html_useful", F.coalesce(useful, F.lit(False))).drop("_is_html")


def valid_items(items: DataFrame, keywords=AUDIT_KEYWORDS, listing_titles=AUDIT_LISTING_TITLES) -> DataFrame:
    """Items with a title, a web address, a notice word and no bare listing title."""
    title, url = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("url", F.lit("")))
    body = F.concat_ws(" ", title, url, F.coalesce("description", F.lit("")))
    staged = stage(items.filter((title != "") & urls.is_http(url)), _t=text.fold_text(title), _f=text.fold_text(body))
    listing = F.col("_t").isin(*listing_titles) & ~urls.is_document_url(url, LINK_DOCUMENT_SUFFIXES)
    return staged.filter(~listing & text.contains_any(F.col("_f"), keywords)).drop("_t", "_f")


# Audit verdicts and the action each one asks for.
ACTIONS = {
    "funcional": "Mantida; crawler recuperou editais validos.",
    "funcional_parcial": "Mantida parcialmente; requer revisao fina de fonte/spider.",
    "sem_editais_encontrados": "Mantida por ora; sem edital detectado na execucao.",
    "exige_spider_especifico": "Requer spider especifico ou seletor dedicado.",
    "exige_javascript": "Requer alternativa oficial sem JavaScript ou spider com renderizacao.",
    "bloqueio_acesso": "Requer avaliacao de bloqueio/headers ou fonte alternativa oficial.",
    "url_invalida": "Requer substituicao por URL oficial funcional.",
}


def source_verdict() -> Column:
    """Verdict of a row with probe, crawl and link-check facts; the first fit decides."""
    http = F.col("status_code")
    error = F.lower(F.concat_ws(" ", "probe_error", "error_message"))
    blocked = F.coalesce(http.isin(401, 403), F.lit(False))
    opens, valid = F.coalesce("opens", F.lit(False)), F.coalesce("valid_items", F.lit(0))
    found = F.coalesce("items_found", F.lit(0))
    failed = (
        F.when(blocked | text.contains_any(error, ("forbidden", "unauthorized")), "bloqueio_acesso")
        .when(F.coalesce(http.isin(404, 410), F.lit(False))
              | text.contains_any(error, ("name or service not known", "no address associated")), "url_invalida")
        .when(error.contains("javascript"), "exige_javascript")
        .when(~opens, "url_invalida")
        .otherwise("funcional_parcial")
    )
    partial = (valid == 0) | (F.col("links_opened") < F.col("links_checked")) | (valid < found)
    return (
        F.when(F.coalesce("failed", F.lit(False)), failed)
        .when(~opens & (valid > 0), "funcional_parcial")
        .when(~opens & blocked, "bloqueio_acesso")
        .when(~opens, "url_invalida")
        .when(~F.coalesce("html_useful", F.lit(False)), F.when(F.coalesce("html_length", F.lit(0)) > 0, "exige_javascript").otherwise("url_invalida"))
        .when((found == 0) & (F.coalesce("keyword_count", F.lit(0)) > 0), "exige_spider_especifico")
        .when(found == 0, "sem_editais_encontrados")
        .when(partial, "funcional_parcial")
        .otherwise("funcional")
    )


def with_verdict(df: DataFrame) -> DataFrame:
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    judged = stage(df, verdict=source_verdict())
    return judged.withColumn("action", F.try_element_at(actions, F.col("verdict")))


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key; the limit applies per map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def audit_sources(
    sources: DataFrame, probes: DataFrame, runs: DataFrame, items: DataFrame, link_checks: DataFrame,
    sample_size: int = 3, **lexicon,
) -> DataFrame:
    """One audited row per source: counts, sampled link checks, samples, verdict, action.

    ``probes``: source_id and probe metrics; ``runs``: source_id, failed, items_found,
    new_items, error_message; ``items``: source_id, pos, title, url, notice_type,
    description; ``link_checks``: url, opens.
    """
    # counts and heads both read the valid items, whose texts are folded: written once
    valid = materialize(valid_items(items, **lexicon).select("source_id", "pos", "title", "url", "notice_type"), "valid-items")
    counts = valid.groupBy("source_id").agg(F.count("*").alias("valid_items"))
    heads = first_n(valid, ["source_id"], ["pos"], max(sample_size, 0))
    checks = link_checks.groupBy("url").agg(F.bool_or("opens").alias("_opens"))
    sample = F.struct("rank", text.audit_truncate(F.col("title"), 220).alias("title"), "url", "notice_type")
    per = heads.join(checks, "url", "left").groupBy("source_id").agg(
        F.count("*").alias("links_checked"),
        F.count_if(F.coalesce("_opens", F.lit(False))).alias("links_opened"),
        F.sort_array(F.collect_list(sample)).alias("samples"),  # at most sample_size rows
    )
    joined = (
        sources.select(F.col("id").alias("source_id"), "institution_id", F.col("name").alias("source_name"), "url", "source_type")
        .join(runs.select("source_id", "failed", "items_found", "new_items", "error_message"), "source_id", "left")
        .join(probes, "source_id", "left")
        .join(counts, "source_id", "left")
        .join(per, "source_id", "left")
    )
    filled = joined.fillna(0, ["items_found", "new_items", "valid_items", "links_checked", "links_opened"])
    if "probe_error" not in filled.columns:
        filled = filled.withColumn("probe_error", F.lit(None).cast("string"))
    return with_verdict(filled)


def compare_runs(before: DataFrame, after: DataFrame, notices: DataFrame, institutions: DataFrame) -> DataFrame:
    """Notices that only the second run knows, described with their institution."""
    fresh = after.select("id").distinct().join(before.select("id"), "id", "left_anti")
    owner = institutions.select(F.col("id").alias("institution_id"), F.col("initials").alias("institution"))
    rows = notices.join(fresh, "id", "left_semi").join(owner, "institution_id")
    return rows.select(
        "id", "institution", "institution_id", "notice_type", text.audit_truncate(F.col("title"), 180).alias("title"),
        "url", "normalized_title", "normalized_url",
    )


def find_duplicates(new: DataFrame, notices: DataFrame, most: int = 5) -> DataFrame:
    """Other notices of the institution with the same URL or the same title, per new notice.

    Each key keeps only its ``most + 1`` least ids, which always hold the answer once the
    notice itself is left out; pairs within a key are never formed.
    """

    def others(column: str, name: str) -> DataFrame:
        keys = ["institution_id", column]
        heads = first_n(notices.select("id", *keys), keys, ["id"], most + 1)
        lists = heads.groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("_ids"))
        met = new.select("id", *keys).join(lists, keys, "left")
        ids = F.slice(F.filter("_ids", lambda i: i != F.col("id")), 1, most)
        none = F.filter(F.array("id"), lambda i: F.lit(False))
        return met.select("id", F.coalesce(ids, none).alias(name))

    joined = others("normalized_url", "same_url_ids").join(others("normalized_title", "same_title_ids"), "id")
    found = joined.filter((F.size("same_url_ids") > 0) | (F.size("same_title_ids") > 0))
    return new.select("id", text.audit_truncate(F.col("title"), 180).alias("title"), "url").join(found, "id")


def in_scope(notices: DataFrame, institutions: DataFrame, initials) -> DataFrame:
    """Active notices of the institutions with the given initials (a list or a frame)."""
    owners = institutions.select(F.col("id").alias("institution_id"), F.col("initials").alias("institution"))
    if isinstance(initials, DataFrame):
        owners = owners.join(initials.select(F.col("initials").alias("institution")), "institution", "left_semi")
    else:
        owners = owners.filter(F.col("institution").isin(list(initials)))
    return notices.filter("is_active").join(owners, "institution_id")


def scope_counts(scoped: DataFrame) -> DataFrame:
    """kind, key, n: per type, the active total, and each institution with a notice."""
    types = scoped.groupBy(F.lit("type").alias("kind"), F.col("notice_type").alias("key")).agg(F.count("*").alias("n"))
    total = scoped.agg(F.count("*").alias("n")).select(F.lit("active").alias("kind"), F.lit("").alias("key"), "n")
    owners = scoped.groupBy(F.lit("institution").alias("kind"), F.col("institution").alias("key")).agg(F.count("*").alias("n"))
    return types.unionByName(total).unionByName(owners)


def type_samples(scoped: DataFrame, types=NOTICE_TYPES, most: int = 3) -> DataFrame:
    """notice_type, n, examples: every type of the list, the newest titles first."""
    listed = scoped.sparkSession.createDataFrame([(t,) for t in types], "notice_type string")
    counts = scoped.groupBy("notice_type").agg(F.count("*").alias("n"))
    heads = first_n(scoped, ["notice_type"], [F.desc("detected_at"), "id"], most)
    titles = heads.groupBy("notice_type").agg(
        F.sort_array(F.collect_list(F.struct("rank", text.audit_truncate(F.col("title"), 140).alias("t")))).alias("_x")
    )
    joined = listed.join(counts, "notice_type", "left").join(titles, "notice_type", "left")
    examples = F.coalesce(F.transform("_x", lambda x: x["t"]), F.array().cast("array<string>"))
    return joined.select("notice_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"), examples.alias("examples"))


def notice_samples(scoped: DataFrame, limit: int = 12) -> DataFrame:
    newest = scoped.orderBy(F.desc("detected_at"), "id").limit(limit)
    return newest.select("id", "institution", "notice_type", text.audit_truncate(F.col("title"), 180).alias("title"), "url")


def audit_rollup(audited: DataFrame) -> DataFrame:
    """One row: functional, partial and failed sources with item totals."""
    zero = F.lit(0).cast("long")
    good, partial = F.col("verdict") == "funcional", F.col("verdict") == "funcional_parcial"
    return audited.agg(
        F.count("*").alias("sources_checked"),
        F.coalesce(F.sum("items_found"), zero).alias("items_found"),
        F.coalesce(F.sum("new_items"), zero).alias("new_items"),
        F.count_if(F.coalesce("failed", F.lit(False))).alias("failed_sources"),
        F.count_if(good).alias("functional"),
        F.count_if(partial).alias("partial"),
        F.count_if(~good & ~partial).alias("not_functional"),
    )
