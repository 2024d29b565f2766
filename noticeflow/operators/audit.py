"""Source audit: gates, page signals, verdicts and the controlled sample."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from noticeflow.functions import text, urls
from noticeflow.functions.staging import stage
from noticeflow.functions.values import code_order, mime_essence
from noticeflow.lexicon import (
    AUDITABLE_STATUSES, AUDIT_DOCUMENT_SUFFIXES, AUDIT_NOTICE_TERMS, EXPECTED_SELECTORS, REDIRECT_HTTP,
    RETRYABLE_HTTP, SKIPPED_STATUSES,
)
from noticeflow.operators.catalog import is_included
from noticeflow.operators.html import extract_signals
from noticeflow.operators.links import first_per_key
from noticeflow.session import discard, materialize

MAX_URL = 2048
MAX_REDIRECTS = 5
MAX_BODY_BYTES = 1_000_000


def audit_gate(sources: DataFrame) -> DataFrame:
    """gate_status and gate_code: null for sources that may be requested."""
    declared = F.coalesce(F.nullif("status", F.lit("")), F.lit("manual_review"))
    skipped, known = declared.isin(*SKIPPED_STATUSES), declared.isin(*AUDITABLE_STATUSES)
    return sources.withColumns({
        "gate_status": F.when(skipped, declared).when(~known, "manual_review"),
        "gate_code": F.when(skipped, F.concat(F.lit("declared_"), declared)).when(~known, "unknown_source_status"),
    })


def admit_urls(df: DataFrame, column: str = "url") -> DataFrame:
    """url_code and url_status of addresses the audit must not open, null for the rest."""
    url = F.trim(F.coalesce(column, F.lit("")))
    staged = stage(df, _p=urls.with_parts(url, lambda p: urls.with_authority(p.netloc, lambda a: F.struct(
        p.scheme.alias("scheme"), a.user.alias("user"), a.host.alias("host"), a.port.alias("port")))))
    port = F.col("_p.port")
    code = (
        F.when((url == "") | (F.length(column) > MAX_URL), "invalid_url")
        .when(~F.col("_p.scheme").isin("http", "https") | (F.col("_p.host") == ""), "invalid_url")
        .when(F.col("_p.user").isNotNull(), "credentials_in_url")
        .when(urls.bad_port(port), "invalid_port")
        .when((port != "") & ~port.try_cast("int").isin(0, 80, 443), "non_standard_port")
        .when(urls.is_audit_document(url, AUDIT_DOCUMENT_SUFFIXES), "document_url")
    )
    out = stage(staged, url_code=code).drop("_p")
    status = F.when(F.col("url_code") == "document_url", "unsupported").when(F.col("url_code").isNotNull(), "manual_review")
    return out.withColumn("url_status", status)


def collapse_attempts(log: DataFrame, max_retries: int = 2) -> DataFrame:
    """Outcome of an attempt log: url_id, attempts, status_code, error_code, status.

    Input: url_id, attempt (from 1), status_code, error ('timeout', 'connection' or null).
    The first attempt that is not retryable ends it, else the last allowed one.
    """
    retry = F.coalesce(F.col("status_code").isin(*RETRYABLE_HTTP), F.lit(False)) | F.col("error").isNotNull()
    rank = F.struct(retry.cast("int"), F.when(retry, -F.col("attempt")).otherwise(F.col("attempt")))
    last = log.filter(F.col("attempt") <= max_retries + 1).groupBy("url_id").agg(
        F.min_by(F.struct("attempt", "status_code", "error"), rank).alias("o")
    )
    failed = F.col("o.error").isNotNull()
    return last.select(
        "url_id",
        F.col("o.attempt").alias("attempts"),
        F.when(~failed, F.col("o.status_code")).alias("status_code"),
        F.when(F.col("o.error") == "timeout", "timeout").when(failed, "connection_failure").alias("error_code"),
        F.when(failed, "temporarily_unavailable").alias("status"),
    )


def _hop(url: Column, code: Column, fetched: Column, redirect: Column, onward: Column) -> Column:
    return F.struct(
        url.alias("url"), code.cast("int").alias("status_code"),
        fetched.alias("fetched"), redirect.alias("redirect"), onward.alias("onward"),
    )


def _unknown_hop(url: Column) -> Column:
    no = F.lit(False)
    return F.array(_hop(url, F.lit(None), no, no, no))


def hop_paths(hops: DataFrame, steps: int) -> DataFrame:
    """Path of each distinct address of a hop log: url, path (its first ``steps`` hops or more).

    Pointer jumping: an open path is joined with the path of the address at its end, so each
    round doubles the distance. Only addresses move, and the side that is looked up holds each
    address once: a page that a third of all chains end at makes no row larger.
    """
    one = hops.filter("url is not null").groupBy("url").agg(F.min(F.struct("status_code", "location")).alias("h"))
    target = F.trim(F.coalesce("h.location", F.lit("")))
    redirect = F.coalesce(F.col("h.status_code").isin(*REDIRECT_HTTP), F.lit(False))
    # The next address belongs to the hop, so it is resolved once per hop, not per visit.
    log = stage(one, end=F.when(redirect & (target != ""), urls.resolve_url(F.col("url"), target)))
    first = _hop(F.col("url"), F.col("h.status_code"), F.lit(True), redirect, F.col("end").isNotNull())
    paths = materialize(log.select("url", F.array(first).alias("path"), "end"), "hop-paths")
    length = 1
    while length < steps:
        there = paths.select(F.col("url").alias("end"), F.col("path").alias("_path"), F.col("end").alias("_end"))
        longer = paths.filter("end is not null").join(there, "end", "left").select(
            "url", F.concat("path", F.coalesce("_path", _unknown_hop(F.col("end")))).alias("path"), F.col("_end").alias("end"))
        doubled = materialize(paths.filter("end is null").unionByName(longer), "hop-paths")
        discard(paths)
        paths, length = doubled, 2 * length
    return paths.drop("end")


def resolve_redirects(requests: DataFrame, hops: DataFrame, max_redirects: int = MAX_REDIRECTS) -> DataFrame:
    """Follow a hop log (url, status_code, location) from each request (id, url).

    id, status_code, final_url, redirect_chain, error_code. The paths of addresses are found
    first; requests meet them in one join. A request without url joins on a private key.
    """
    paths = hop_paths(hops, max_redirects + 1).select(F.col("url").alias("_key"), "path")
    keyed = requests.select("id", "url", F.coalesce("url", F.concat(F.lit("\x00"), F.col("id").cast("string"))).alias("_key"))
    walked = keyed.join(paths, "_key", "left").select(
        "id", F.slice(F.coalesce("path", _unknown_hop(F.col("url"))), 1, max_redirects + 1).alias("path"))
    ended = stage(walked, last=F.element_at("path", -1))
    error = (
        F.when(~F.col("last.fetched"), "not_fetched")
        .when(F.col("last.redirect") & ~F.col("last.onward"), "redirect_without_location")
        .when(F.col("last.redirect"), "too_many_redirects")
    )
    return ended.select(
        "id", F.col("last.status_code").alias("status_code"), F.when(error.isNull(), F.col("last.url")).alias("final_url"),
        F.transform(F.slice("path", 2, max_redirects + 1), lambda p: p["url"]).alias("redirect_chain"), error.alias("error_code"),
    )


def robots_gate(requests: DataFrame, robots: DataFrame, rules: DataFrame) -> DataFrame:
    """robots_code of each request (id, url): null when allowed.

    ``robots``: origin, status_code.  ``rules``: origin, rule_order, allow, prefix of the
    auditing agent, parsed beforehand; one origin's rules are the lines of one file.
    """
    lines = rules.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("rule_order", "allow", "prefix"))).alias("lines")
    )
    origins = robots.join(lines, "origin", "left")
    parts = stage(requests, origin=F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0),
                  _path=F.regexp_extract("url", r"(?s)^[a-z]+://[^/?#]*([^#]*)", 1))
    path = F.when(F.col("_path").startswith("/"), F.col("_path")).otherwise(F.concat(F.lit("/"), "_path"))
    joined = stage(parts.withColumn("_path", path).join(origins, "origin", "left"), _rule=F.get(F.filter(
        "lines", lambda r: (r["prefix"] == "*") | F.col("_path").startswith(r["prefix"])), F.lit(0)))
    code = (
        F.when(F.col("status_code") == 404, None)
        .when(F.col("status_code").isin(401, 403), "robots_disallowed")
        .when(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)), "robots_unavailable")
        .when(~F.coalesce("_rule.allow", F.lit(True)), "robots_disallowed")
    )
    return joined.select("id", "url", "origin", code.alias("robots_code"))


@F.pandas_udf(T.StringType())
def _address_problem(addresses: pd.Series) -> pd.Series:
    def problem(address):
        try:
            return None if ipaddress.ip_address(address).is_global else "non_public_destination"
        except ValueError:
            return "invalid_dns_address"

    return addresses.map(lambda a: None if a is None else problem(a))


def address_gate(addresses: DataFrame) -> DataFrame:
    """host, dns_code, dns_status over resolved addresses; the first bad address decides."""
    bare = F.substring_index("address", "%", 1)
    distinct = addresses.select("host", bare.alias("address")).distinct()
    judged = distinct.withColumn("_problem", _address_problem("address"))
    worst = judged.groupBy("host").agg(
        F.min_by("_problem", F.when(F.col("_problem").isNotNull(), F.col("address"))).alias("_p"),
        F.count("address").alias("n"),
    )
    code = F.when(F.col("n") == 0, "dns_failure").otherwise(F.col("_p"))
    status = F.when(F.col("n") == 0, "temporarily_unavailable").when(F.col("_p").isNotNull(), "manual_review")
    return worst.select("host", "n", code.alias("dns_code"), status.alias("dns_status"))


def page_signals(
    pages: DataFrame, selectors: dict = EXPECTED_SELECTORS, terms=AUDIT_NOTICE_TERMS, bare_references: bool = True
) -> DataFrame:
    """Signals per page (page_id, url, html, recommended_spider).

    Adds page_title (300 letters at most), html_valid, expected_elements_found,
    notice_terms_found, has_password and the lower-case visible text.
    """
    wanted = F.create_map(*[
        x for name, items in selectors.items() for x in (F.lit(name), F.array(*[F.lit(i) for i in items]))
    ])
    known = sorted({s for items in selectors.values() for s in items})
    spider = F.lower(F.coalesce("recommended_spider", F.lit("generic")))
    seen = extract_signals(pages.withColumn("_spider", spider), known, carry="_spider", bare_references=bare_references)
    lowered = stage(seen, lower_text=F.lower(text.squash(F.col("body_text"))))
    expected = F.coalesce(F.try_element_at(wanted, F.col("_spider")), F.try_element_at(wanted, F.lit("generic")))
    return lowered.select(
        "page_id",
        "url",
        F.nullif(F.substring(text.squash(F.col("title")), 1, 300), F.lit("")).alias("page_title"),
        F.col("has_structure").alias("html_valid"),
        F.arrays_overlap("matched", expected).alias("expected_elements_found"),
        text.contains_any(F.col("lower_text"), terms).alias("notice_terms_found"),
        "has_password",
        "link_count",
        "lower_text",
    )


# Words of a challenge page.
CAPTCHA_WORDS = ("captcha", "recaptcha", "hcaptcha")


def block_signal() -> Column:
    """Blocking reason of a signal row with ``headers`` (map), null when there is none."""
    title = F.lower(F.coalesce("page_title", F.lit("")))
    body = F.col("lower_text")
    header = lambda n: F.try_element_at("headers", F.lit(n))
    return (
        F.when(F.col("has_password"), "authentication_required")
        .when(text.contains_any(title, CAPTCHA_WORDS) | text.contains_any(body, CAPTCHA_WORDS), "captcha_detected")
        .when(F.lower(header("cf-mitigated")) == "challenge", "cloudflare_challenge")
        .when(
            title.contains("just a moment") & (body.contains("cloudflare") | header("cf-ray").isNotNull()),
            "cloudflare_challenge",
        )
    )


def domain_checks(requested: Column, final: Column, official: Column, redirected: Column) -> dict[str, Column]:
    """cross_domain and domain_matches_institution (null without an official site)."""
    family = lambda url: urls.domain_family(urls.host_of(url))
    own = F.coalesce(official, F.lit("")) != ""
    return {
        "cross_domain": redirected & ~family(requested).eqNullSafe(family(final)),
        "domain_matches_institution": F.when(own, family(official).eqNullSafe(family(final))),
    }


# Wording of verdict evidence.
_MISSING = "HTML acessível, mas faltam: "
_CONFIRMED = (
    "HTML, título, termos de editais e elementos esperados confirmados; "
    "compatibilidade do spider é provável, sem executar coleta"
)


def audit_verdicts(fetched: DataFrame, max_body: int = MAX_BODY_BYTES) -> DataFrame:
    """status, error_code and evidence for fetched sources; the first rule that fits decides.

    Needs gate_status/gate_code, failure_status/failure_code (admission, DNS, robots or
    fetch), http_status, body_bytes, content_type, block, cross_domain, html_valid,
    page_title, expected_elements_found, notice_terms_found, recommended_spider, attempts.
    """
    http, kind = F.col("http_status"), mime_essence(F.col("content_type"))
    is_html = kind.isin("", "text/html", "application/xhtml+xml")
    spider = F.lower(F.coalesce("recommended_spider", F.lit("generic")))
    lacking = F.array_compact(F.array(
        F.when(~F.col("html_valid"), "estrutura html/body"),
        F.when(F.coalesce("page_title", F.lit("")) == "", "título"),
        F.when(~F.col("expected_elements_found"), F.concat(F.lit("elementos esperados para spider "), spider)),
        F.when(~F.col("notice_terms_found"), "termos de edital/seleção"),
    ))
    shown = http.cast("string")
    verdict = lambda status, code, evidence: F.struct(
        (status if isinstance(status, Column) else F.lit(status)).alias("status"),
        (code if isinstance(code, Column) else F.lit(code).cast("string")).alias("error_code"),
        (evidence if isinstance(evidence, Column) else F.lit(evidence)).alias("evidence"),
    )
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    ladder = (
        F.when(F.col("gate_status").isNotNull(), verdict(F.col("gate_status"), F.col("gate_code"), F.col("gate_code")))
        .when(F.col("failure_status").isNotNull(), verdict(F.col("failure_status"), F.col("failure_code"), F.col("failure_code")))
        .when(F.col("body_bytes") > max_body, verdict("unsupported", "body_too_large", say("corpo excede ", str(max_body), " bytes")))
        .when(http.isin(401, 403), verdict("manual_review", "authentication_or_access_blocked",
              say("acesso recusado sem tentativa de contorno (HTTP ", shown, ")")))
        .when(http == 410, verdict("inactive", "http_410", "a fonte respondeu HTTP 410 (Gone)"))
        .when(http == 404, verdict("manual_review", "http_404", "a fonte respondeu HTTP 404"))
        .when(http.isin(*RETRYABLE_HTTP), verdict("temporarily_unavailable", say("http_", shown),
              say("a fonte respondeu HTTP ", shown, " após ", F.col("attempts").cast("string"), " tentativa(s)")))
        .when(~F.coalesce(http.between(200, 299), F.lit(False)), verdict("manual_review",
              say("unexpected_http_", F.coalesce(shown, F.lit("none"))), say("resposta HTTP inesperada: ", F.coalesce(shown, F.lit("none")))))
        .when(~is_html, verdict("unsupported", "non_html_content", say("conteúdo não HTML recusado: ", kind)))
        .when(F.col("block").isNotNull(), verdict("manual_review", F.col("block"),
              say("bloqueio detectado (", F.col("block"), "); nenhum contorno foi tentado")))
        .when(F.col("cross_domain"), verdict("manual_review", "cross_domain_redirect",
              "redirect terminou em família de domínio diferente"))
        .when(F.size("_lacking") > 0, verdict("partial", "structure_partial", say(_MISSING, F.array_join("_lacking", ", "))))
        .otherwise(verdict("verified", None, _CONFIRMED))
    )
    judged = stage(stage(fetched, _lacking=lacking), _v=ladder)
    kept = [c for c in fetched.columns if c not in ("status", "error_code", "evidence")]
    return judged.select(*kept, "_v.status", "_v.error_code", "_v.evidence")


def sample_candidates(catalog: DataFrame, regions=None) -> DataFrame:
    """Auditable sources of eligible institutions with their rank keys.

    ``catalog`` is at source grain: official_code, region, eligibility_status,
    catalog_source_id, status, url, recommended_spider, priority_rank.
    """
    ok = is_included(F.coalesce("eligibility_status", F.lit("included")))
    df = catalog.filter(ok & F.col("status").isin(*AUDITABLE_STATUSES) & (F.coalesce("url", F.lit("")) != ""))
    if regions is not None:
        df = df.filter(F.col("region").isin(list(regions)))
    rank = F.array_position(F.array(*[F.lit(s) for s in AUDITABLE_STATUSES]), F.col("status"))
    numeric, number, _ = code_order(F.col("official_code"))
    return df.select(
        "official_code", "region", "catalog_source_id", "status", "url",
        F.coalesce(F.nullif("recommended_spider", F.lit("")), F.lit("generic")).alias("spider"),
        (rank - 1).cast("int").alias("status_rank"),
        "priority_rank",
        F.when(numeric == 0, number).otherwise(F.lit(10**12)).cast("decimal(38,0)").alias("code_number"),
    )


RANK = ["status_rank", "priority_rank", "code_number", "official_code", "catalog_source_id"]


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Best candidate per (region, extractor): all the greedy choice ever looks at."""
    return first_per_key(candidates, ["region", "spider"], RANK)


def sample_sources(candidates: DataFrame, max_samples: int = 10, regions=None) -> DataFrame:
    """At most ten pages: one per region, new extractors first, then one per missing extractor.

    ``regions`` is the order in which regions choose; by default they are sorted. Source ids are
    unique. A choice then looks at the ``max_samples + 1`` best extractors of a region, and at the
    best candidate of the first ``2 * max_samples`` extractors: Spark cuts the candidates to these
    rows, whatever their number, and only they come to the driver.
    """
    if not 1 <= max_samples <= 10:
        raise ValueError("max_samples must be between 1 and 10")
    spark, some = candidates.sparkSession, 2 * max_samples
    if regions is None:
        regions = [r[0] for r in candidates.select("region").dropna().distinct().orderBy("region").limit(some).collect()]
    regions = list(dict.fromkeys(regions))
    order = spark.createDataFrame(list(enumerate(regions)), "region_rank int, region string")
    asked = candidates.join(order, "region")
    per_region = first_per_key(asked, ["region", "spider"], RANK)
    w = Window.partitionBy("region").orderBy(*RANK)
    per_region = per_region.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_samples + 1).drop("_rn")
    per_region = per_region.orderBy("region_rank", *RANK).limit(some * (max_samples + 1)).withColumn("step", F.lit("region"))
    per_spider = first_per_key(asked, ["spider"], RANK).orderBy("spider").limit(some).withColumn("step", F.lit("spider"))
    rows = per_region.unionByName(per_spider).collect()
    rows.sort(key=lambda r: tuple(r[c] for c in RANK))
    by_region = {name: [r for r in rows if r["step"] == "region" and r["region"] == name] for name in regions}
    by_spider = {r["spider"]: r for r in rows if r["step"] == "spider"}
    chosen: dict[str, object] = {}
    seen: set[str] = set()

    def choose(row) -> None:
        if len(chosen) < max_samples and row["catalog_source_id"] not in chosen:
            chosen[row["catalog_source_id"]] = row
            seen.add(row["spider"])

    for options in by_region.values():
        if options:
            choose(next((r for r in options if r["spider"] not in seen), options[0]))
    for spider in sorted(by_spider):
        if spider not in seen:
            choose(by_spider[spider])
    return spark.createDataFrame([tuple(r[c] for c in candidates.columns) for r in chosen.values()], candidates.schema)


def sample_gaps(sample: DataFrame, candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """kind (region or extractor), value, represented."""
    def gaps(kind, wanted, have):
        seen = have.distinct().withColumn("_in", F.lit(True))
        return wanted.distinct().join(seen, "value", "left").select(
            F.lit(kind).alias("kind"), "value", F.col("_in").isNotNull().alias("represented"))

    value = lambda df, c: df.select(F.col(c).alias("value"))
    return gaps("region", value(regions, "region"), value(sample, "region")).unionByName(
        gaps("extractor", value(candidates, "spider"), value(sample, "spider")))


def audit_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def pending_results(results: DataFrame) -> DataFrame:
    """Results that are not verified with their reason."""
    reason = F.coalesce(F.nullif("error_code", F.lit("")), F.col("evidence"))
    return results.filter("status <> 'verified'").select("source_id", "institution_name", "status", reason.alias("reason"))
