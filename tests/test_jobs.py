"""Jobs on small fixtures: brute-force twins, idempotence, publishing, streams."""

import datetime
import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeflow.operators import alerts, audit, checks, coverage, crawl_ops, field_audit, html, ingest, legacy, links, posts, upsert
from noticeflow.plans.crawl import run_crawl
from noticeflow.plans.reports import coverage_report, match_run
from noticeflow.session import ARROW_BYTES, scratch_path
from noticeflow.sources import readers, sinks
from noticeflow.streaming import jobs
from noticeflow.workload import all_queries
from noticeflow.workload.domain import Tables

def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def like(pattern, text):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    return re.search(out.lower(), text.lower(), re.S) is not None


@pytest.mark.parametrize("limit", [7, 100_000])
def test_keyword_hits_match_brute_force(spark, limit):
    rng = random.Random(11)
    letters = "abÇç .%_"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    notices = [(i, i % 3, "t", word(rng.randint(0, 12)), word(rng.randint(0, 30))) for i in range(60)]
    keywords = list({word(rng.randint(1, 6)) for _ in range(40)} | {"%", "_", "a%b", r"\%", r"a\_", "b.", "ÇA", "%_", "ab a"})
    df = spark.createDataFrame(notices, "id long, institution_id long, notice_type string, title string, description string")
    kws = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    got = {(r["id"], r["keyword"]) for r in alerts.keyword_hits(df, kws, limit).collect()}
    want = {(n[0], k) for n in notices for k in keywords if like(k, n[3]) or like(k, n[4])}
    assert got == want


def test_match_is_idempotent_and_scoped(spark):
    notices = spark.createDataFrame(
        [(1, 1, "edital", "Bolsa A", None, True), (2, 2, "concurso", "x", "tem BOLSA", True), (3, 1, "edital", "bolsa", "", False)],
        "id long, institution_id long, notice_type string, title string, description string, is_active boolean")
    rules = spark.createDataFrame(
        [(1, 10, "bolsa", None, None, True), (2, 10, "bolsa", 1, "edital", True), (3, 11, "bolsa", 2, "edital", True), (4, 12, "bolsa", None, None, False)],
        "id long, user_id long, keyword string, institution_id long, notice_type string, is_active boolean")
    empty = spark.createDataFrame([], "user_id long, notice_id long")
    created, stats = match_run(rules, notices, empty)
    assert {(r["user_id"], r["notice_id"]) for r in created.collect()} == {(10, 1), (10, 2)}
    assert stats.first().asDict() == {"alerts_checked": 3, "notices_checked": 3, "notifications_created": 2, "duplicates_skipped": 1}
    again, stats = match_run(rules, notices, created)
    assert again.count() == 0 and stats.first()["duplicates_skipped"] == 3


def test_new_notices_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for pos in range(300):
        inst, url, title = rng.randint(1, 2), f"u{rng.randint(1, 40) if pos % 3 else 1}", f"t{rng.randint(1, 3)}"
        rows.append((rng.randint(1, 4), pos, inst, url, f"{inst}|{title}|{url}"))
    history = [(1, "u2", "x"), (2, "u3", "y"), (1, "other", "1|t1|u5"), (2, "u3", "y")]
    got = ingest.new_notices(
        spark.createDataFrame(rows, "source_id long, pos int, institution_id long, normalized_url string, fingerprint string"),
        spark.createDataFrame(history, "institution_id long, normalized_url string, fingerprint string"))
    seen_urls, prints, want = {h[:2] for h in history}, {h[2] for h in history}, set()
    for source, pos, inst, url, fp in sorted(rows):
        if fp not in prints and (inst, url) not in seen_urls:
            seen_urls.add((inst, url))
            want.add(pos)
    assert {r["pos"] for r in got.collect()} == want


def test_keywords_with_a_common_beginning(spark):
    words = [f"chamada docente campus {n}" for n in range(400)]
    notices = spark.createDataFrame(
        [(i, 1, "edital", f"Chamada Docente CAMPUS {i} aberta", "x" if i % 2 else None) for i in range(0, 400, 7)],
        "id long, institution_id long, notice_type string, title string, description string")
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = {(i, w) for i in range(0, 400, 7) for w in words if w in f"chamada docente campus {i} aberta"}
    for limit in (50, 1000):
        got = alerts.keyword_hits(notices, keywords, limit)
        assert {(r["id"], r["keyword"]) for r in got.collect()} == want


def test_a_hundred_thousand_keywords(spark):
    rng = random.Random(8)
    vocabulary = [f"k{i:06d}x" for i in range(100_000)] + ["", "%", "_", "k00_001x", "%zz%"]
    rows = [(i, 1, "edital", f"EDITAL K{rng.randrange(200_000):06d}X e mais", f"k{i:06d}x " * 3 if i % 2 else None) for i in range(300)]
    notices = spark.createDataFrame(rows, "id long, institution_id long, notice_type string, title string, description string")
    keywords = spark.createDataFrame([(k,) for k in [*vocabulary, None]], "keyword string")
    want = set()
    for n, _, _, title, more in rows:
        text = (title + " " + (more or "")).lower()
        want |= {(n, k) for k in re.findall(r"k\d{6}x", text) if int(k[1:7]) < 100_000} | {(n, k) for k in ("", "%", "_")}
        want |= {(n, "k00_001x")} if re.search("k00.001x", text) else set()
    for size in (100_005, 30_000):
        hits = alerts.keyword_hits(notices, keywords, size)
        assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
        assert {(r["id"], r["keyword"]) for r in hits.collect()} == want
    assert alerts.keyword_hits(notices, keywords.limit(0)).count() == 0


def test_crawl_job_runs_twice(spark):
    page = "<article><h2>Edital 1 de bolsas</h2><a href='e1.pdf'>Acesse aqui</a></article><a href='/edital-2?utm_a=1'>Edital 2</a>"
    sources = spark.createDataFrame(
        [(1, 7, "a", "https://h.org/n/", "x", True), (2, 7, "b", "https://h.org/m/", "x", True), (3, 8, "c", "https://z.org/", "x", True)],
        "id long, institution_id long, name string, url string, source_type string, is_active boolean",
    ).withColumns({c: F.lit(None).cast(t) for c, t in
                   (("last_checked_at", "timestamp"), ("last_success_at", "timestamp"), ("last_error_message", "string"))})
    institutions = spark.createDataFrame([(7, True), (8, False)], "id long, is_active boolean")
    pages = spark.createDataFrame([(1, "https://h.org/n/", page)], "page_id long, url string, html string")
    status = spark.createDataFrame([(1, None), (2, "timeout")], "source_id long, error_message string")
    history = spark.createDataFrame([], "institution_id long, normalized_url string, fingerprint string")
    first = run_crawl(pages, status, sources, institutions, history, now())
    assert {(r["url"], r["notice_type"]) for r in first.notices.collect()} == {
        ("https://h.org/n/e1.pdf", "bolsa"), ("https://h.org/edital-2", "edital")}
    log = {r["source_id"]: (r["status"], r["items_found"], r["new_items"]) for r in first.runs.collect()}
    assert log == {1: ("completed", 2, 2), 2: ("failed", 0, 0)}
    state = {r["id"]: r["last_error_message"] for r in first.sources.collect()}
    assert state == {1: None, 2: "timeout", 3: None}
    assert ingest.run_summary(first.runs).first().asDict() == {
        "sources_checked": 2, "items_found": 2, "new_items": 2, "failed_sources": 1}
    second = run_crawl(pages, status, sources, institutions, first.notices, now())
    assert second.notices.count() == 0


def test_crawl_job_reads_every_kind_of_source(spark):
    kinds = {1: "x", 2: "WORDPRESS", 3: "PAGINATED_HTML", 4: "x", 5: "WORDPRESS"}
    sources = spark.createDataFrame(
        [(i, 7, f"s{i}", f"https://h{i}.example/", k, True) for i, k in kinds.items()],
        "id long, institution_id long, name string, url string, source_type string, is_active boolean",
    ).withColumns({c: F.lit(None).cast(t) for c, t in
                   (("last_checked_at", "timestamp"), ("last_success_at", "timestamp"), ("last_error_message", "string"))})
    institutions = spark.createDataFrame([(7, True)], "id long, is_active boolean")
    shared = "<a href='https://all.example/n'>Edital comum</a>"
    pages = spark.createDataFrame(
        [(1, "https://h1.example/", "<a href='/a'>Edital A</a>" + shared), (2, "https://h2.example/", "<a href='/p1'>Edital de fora</a>"),
         (3, "https://h3.example/", "<a href='/c'>Edital C</a><a rel='next' href='/2'>2</a>"), (4, "https://h4.example/", shared)],
        "page_id long, url string, html string")
    more = spark.createDataFrame([(-1, "https://h3.example/2", "<a href='/d'>Edital D</a>")], "page_id long, url string, html string")
    payload = '[{"link":"/p1","title":{"rendered":"Edital P"},"excerpt":{"rendered":"x"}}]'
    responses = spark.createDataFrame(
        [(2, "https://h2.example/", 0, 200, payload), (5, "https://h5.example/", 0, 200, payload)],
        "source_id long, url string, term_order int, status_code int, payload string")
    status = spark.createDataFrame([(1, "broken"), (2, None), (3, None), (4, None), (5, "timeout")], "source_id long, error_message string")
    history = spark.createDataFrame([], "institution_id long, normalized_url string, fingerprint string")
    done = run_crawl(pages, status, sources, institutions, history, now(), responses=responses, more_pages=more)
    assert {(r["source_id"], r["title"], r["url"]) for r in done.notices.collect()} == {
        (2, "Edital P", "https://h2.example/p1"), (3, "Edital C", "https://h3.example/c"), (3, "Edital D", "https://h3.example/d"),
        (4, "Edital comum", "https://all.example/n"), (5, "Edital P", "https://h5.example/p1")}
    log = {r["source_id"]: (r["status"], r["items_found"], r["new_items"]) for r in done.runs.collect()}
    assert log == {1: ("failed", 0, 0), 2: ("completed", 1, 1), 3: ("completed", 2, 2), 4: ("completed", 1, 1), 5: ("completed", 1, 1)}


def test_stream_equals_batch(spark):
    root = scratch_path(spark, "stream-test")
    sources = spark.createDataFrame([(i, i % 2, f"https://h{i}.org/") for i in range(6)], "id long, institution_id long, url string")
    pages = spark.createDataFrame(
        [(i, f"https://h{i}.org/", f"<a href='https://s.org/{i % 4}'>edital {i}</a>") for i in range(6)], readers.PAGE_SCHEMA)
    pages.repartition(3).write.parquet(f"{root}/pages")
    jobs.start_ingest(spark, f"{root}/pages", sources, links.extract_generic, f"{root}/out", f"{root}/ck", now()).awaitTermination()
    stored = jobs.stored_notices(spark, f"{root}/out")
    normalized = ingest.normalize_items(links.extract_generic(pages).withColumnRenamed("page_id", "source_id"), sources)
    none = spark.createDataFrame([], "institution_id long, normalized_url string, fingerprint string")
    keys = lambda df: sorted((r["institution_id"], r["normalized_url"]) for r in df.collect())
    assert keys(stored) == keys(ingest.new_notices(normalized, none))


def test_health_order(spark):
    sources = spark.createDataFrame(
        [(1, True, "2024-01-01", None), (2, True, "2024-01-01", "boom"), (3, True, None, None), (4, False, None, None), (5, True, "2024-01-01", None), (6, True, "2024-01-01", None)],
        "id long, is_active boolean, last_checked_at string, last_error_message string")
    runs = spark.createDataFrame(
        [(1, 1, "completed", 4, "2024-01-01"), (2, 5, "completed", 0, "2024-01-02"), (3, 6, "completed", 3, "2024-01-01"), (4, 6, "failed", 0, "2024-01-01")],
        "id long, source_id long, status string, items_found long, started_at string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("new_items", "error_message", "finished_at")})
    got = {r["id"]: r["health_status"] for r in crawl_ops.source_health(sources, runs).collect()}
    assert got == {1: "ok", 2: "error", 3: "never_checked", 4: "inactive", 5: "warning", 6: "error"}


def catalog_rows(spark, rows):
    return spark.createDataFrame(rows, "official_code string, official_name string, initials string, state string, coverage_status string, coverage_notes string, official_site_url string, eligibility_status string, region string, catalog_order long")


def test_upsert_is_idempotent_and_protects_manual_fields(spark):
    cat = catalog_rows(spark, [("1", "Universidade Á", "UA", "SP", "partial", None, "https://a.br", "included", "Sul", 1),
                               ("2", "Escola B", "EB", "RJ", "verified", None, "https://b.br", "included", "Sul", 2)])
    reg = spark.createDataFrame(
        [(50, "universidade a", "ua", "sp", None, "old", None, "https://mine.br", None, False)],
        "id long, name string, initials string, state string, official_code string, source_discovery_status string, source_discovery_notes string, official_site_url string, eligibility_status string, is_active boolean",
    ).withColumn("region", F.lit(None).cast("string"))
    matches, conflicts = upsert.resolve_institutions(cat, reg)
    assert conflicts.count() == 0
    assert [(r["official_code"], r["id"], r["tier"]) for r in matches.collect()] == [("1", 50, 2)]
    merged = upsert.upsert_institutions(cat, reg, matches)
    rows = {r["official_code"]: r for r in merged.collect()}
    assert (rows["1"]["name"], rows["1"]["official_site_url"], rows["1"]["is_active"], rows["1"]["action"]) == ("universidade a", "https://mine.br", False, "updated")
    assert rows["2"]["action"] == "created" and rows["2"]["is_active"]
    after = merged.drop("action")
    matches, _ = upsert.resolve_institutions(cat, after)
    assert {r["action"] for r in upsert.upsert_institutions(cat, after, matches).collect()} == {"ignored"}


def test_publish_keeps_the_old_snapshot_on_conflict(spark):
    root = scratch_path(spark, "publish-test")
    one = spark.createDataFrame([(1, None)], "id long, action string")
    bad = spark.createDataFrame([("x",)], "rule string")
    src = one.withColumn("replaced", F.lit(False))
    first = upsert.publish_upsert(one, src, [bad.limit(0)], root)
    with pytest.raises(checks.RuleViolation):
        upsert.publish_upsert(one.limit(0), src, [bad], root)
    ids = lambda: {k: [r["id"] for r in d.collect()] for k, d in sinks.read_set(spark, root).items()}
    assert ids() == {"institutions": [1], "sources": [1]} and sinks.manifest(spark, root) == first
    assert sinks.read_current(spark, f"{root}/none") is None and sinks.read_set(spark, f"{root}/none") == {}


def test_a_crash_between_two_tables_leaves_both_old(spark, monkeypatch):
    root = scratch_path(spark, "publish-crash")
    frame = lambda i: spark.createDataFrame([(i,)], "id long")
    first = sinks.publish_set({"a": frame(1), "b": frame(1)}, root)
    write = sinks.append
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        def second_fails(df, path, *more):
            if "/b/" in path:
                raise RuntimeError("lost")
            write(df, path, *more)

        broken.setattr(sinks, "append", second_fails)
        sinks.publish_set({"a": frame(2), "b": frame(2)}, root)
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(sinks, "_switch", lambda *_: (_ for _ in ()).throw(RuntimeError("lost before the rename")))
        sinks.publish_set({"a": frame(3), "b": frame(3)}, root)
    ids = lambda: {k: [r["id"] for r in d.collect()] for k, d in sinks.read_set(spark, root).items()}
    assert ids() == {"a": [1], "b": [1]}
    assert len(sinks.drop_unreferenced(spark, root)) == 3 and ids() == {"a": [1], "b": [1]}
    second = sinks.publish_set({"b": frame(4)}, root)
    assert ids() == {"a": [1], "b": [4]} and second["a"] == first["a"]
    assert sinks.drop_unreferenced(spark, root, keep=(first,)) == []
    assert sinks.drop_unreferenced(spark, root) == [f"b/v={first['b']}"] and ids() == {"a": [1], "b": [4]}


def test_new_rows_never_meet_existing_ids(spark):
    hashed = spark.sql("SELECT xxhash64('institution', '2') AS i").first()[0]
    cat = catalog_rows(spark, [(str(c), f"Escola {c}", f"E{c}", "RJ", "verified", None, "https://b.br", "included", "Sul", c) for c in range(2, 40)])
    reg = spark.createDataFrame(
        [(hashed, "Outra", "OU", "SP", None, "old", None, None, None, True), (7, "Mais", "MA", "SP", None, "old", None, None, None, True)],
        "id long, name string, initials string, state string, official_code string, source_discovery_status string, source_discovery_notes string, official_site_url string, eligibility_status string, is_active boolean",
    ).withColumn("region", F.lit(None).cast("string"))
    matches, _ = upsert.resolve_institutions(cat, reg)
    rows = upsert.upsert_institutions(cat, reg, matches).collect()
    top = max(hashed, 7)
    assert len(rows) == 40 and sorted(r["id"] for r in rows if r["action"] == "created") == list(range(top + 1, top + 39))
    assert {r["name"] for r in rows if r["id"] in (hashed, 7)} == {"Outra", "Mais"}


SAMPLE_SCHEMA = "official_code string, region string, catalog_source_id string, status_rank int, spider string, priority_rank int, status string, url string"


def sampled(spark, rows, *args, **more):
    full = [(str(n), reg, c, st, spi, p, "verified", "u") for reg, spi, st, p, n, c in rows]
    df = spark.createDataFrame(full, SAMPLE_SCHEMA).withColumn("code_number", F.col("official_code").cast("decimal(38,0)"))
    return [r["catalog_source_id"] for r in audit.sample_sources(df, *args, **more).collect()]


def test_sample_prefers_new_extractors_then_fills_the_missing(spark):
    rows = [
        ("N", "x", 0, 1, 5, "n-best"), ("N", "y", 1, 1, 1, "n-other"),
        ("S", "x", 0, 1, 1, "s-best"), ("S", "z", 1, 9, 9, "s-new"),
        ("L", "x", 2, 1, 1, "l-only"), ("L", "x", 2, 2, 1, "l-worse"),
    ]
    assert sampled(spark, rows) == ["l-only", "n-other", "s-new"]
    assert sampled(spark, rows, regions=["S", "N", "L"]) == ["s-best", "n-other", "l-only", "s-new"]
    assert sampled(spark, rows, 2, regions=["S", "N", "L", "S"]) == ["s-best", "n-other"]
    assert sampled(spark, rows, regions=["N"]) == ["n-best", "n-other"]


def test_sample_of_many_extractors_is_cut_before_the_driver(spark):
    rows = [("N", f"e{i:03d}", 0, 1, i, f"c{i}") for i in range(300)]
    assert sampled(spark, rows, 4) == ["c0", "c1", "c2", "c3"]


def test_duplicates_in_a_hot_group(spark):
    rows = [(i, 1, "t", "same" if i < 200 else f"u{i}", f"n{i % 7}" if i > 190 else f"x{i}") for i in range(220)]
    df = spark.createDataFrame(rows, "id long, institution_id long, title string, normalized_url string, normalized_title string").withColumn("url", F.col("normalized_url"))
    got = {r["id"]: (r["same_url_ids"], r["same_title_ids"]) for r in field_audit.find_duplicates(df, df).collect()}
    for i, *_ , url, title in rows:
        want = tuple([o[0] for o in rows if o[0] != i and o[k] == rows[i][k]][:5] for k in (3, 4))
        assert tuple(got.get(i, ([], []))) == want


def test_coverage_report_parts(spark):
    cat = catalog_rows(spark, [("1", "A", "AA", "SP", "verified", None, None, "included", "Sul", 1), ("2", "B", "BB", "SP", "partial", "n", None, "included", "Sul", 2),
                               ("3", "C", "CC", "RJ", "partial", None, None, "excluded", "Norte", 3)]).withColumns({
        "official_code_origin": F.lit("census"), "administrative_category_code": F.lit(1), "administrative_category": F.lit("P"),
        "academic_organization_code": F.lit(1), "academic_organization": F.lit(None).cast("string")})
    mapped = spark.createDataFrame([("1", "verified", "generic", None, "2026-01-02T00:00:00Z"), ("3", "partial", "sigaa", "x", None)],
                                   "official_code string, status string, recommended_spider string, capture_validated_at string, last_verified_at string")
    inst = spark.createDataFrame([(9, "A", "aa", "sp", None, True)], "id long, name string, initials string, state string, official_code string, is_active boolean")
    src = spark.createDataFrame([(9, True, 60, datetime.datetime(2024, 1, 19, 1))], "institution_id long, is_active boolean, check_frequency_minutes int, last_success_at timestamp").withColumn("capture_validated_at", F.lit(None).cast("timestamp"))
    parts = coverage_report(cat, mapped, inst, src, now())
    funnel = {r["stage"]: (r["institutions"], r["percent"]) for r in parts["funnel"].collect()}
    assert funnel == {"registered": (1, 50.0), "mapped": (1, 50.0), "verified": (1, 50.0), "capture_validated": (0, 0.0), "active_monitoring": (1, 50.0)}
    assert [r["reason"] for r in parts["pending"].collect()] == ["n"]
    assert parts["last_audit"].first()[0] == "2026-01-02"
    labels = {r["label"] for r in parts["breakdown"].filter("dimension = 'organization'").collect()}
    assert labels == {coverage.UNLABELLED}


def test_signals_on_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<title> A  b </title><body>x<input type='password'>"), (2, "u", "<html><body><p>just &quot;text"), (3, "u", None)],
        readers.PAGE_SCHEMA).withColumn("recommended_spider", F.lit("sigaa"))
    got = {r["page_id"]: r for r in audit.page_signals(pages).collect()}
    assert (got[1]["page_title"], got[1]["html_valid"], got[1]["has_password"]) == ("A b", False, True)
    assert (got[2]["page_title"], got[2]["html_valid"], got[2]["lower_text"]) == (None, True, 'just "text')
    assert got[3]["lower_text"] == ""
    assert html.extract_links(pages.drop("recommended_spider")).count() == 0


def test_legacy_match_needs_exactly_one(spark):
    census = spark.createDataFrame([("1", "UA", "UA", "Universidade A", "SP"), ("2", None, "IES-2", "Universidade A", "SP"), ("3", "UC", "UC", "Escola C", "SP")],
                                   "official_code string, official_initials string, initials string, official_name string, state string")
    rows = spark.createDataFrame([(1, "x", "ua", "sp"), (2, "universidade a", "zz", "SP"), (3, "escola c", "q", "SP"), (4, "z", "uc", "SP"), (5, "n", "n", "RJ")],
                                 "legacy_id long, name string, initials string, state string")
    got = {r["legacy_id"]: (r["candidates"], r["official_code"], r["conflict"]) for r in legacy.match_legacy(rows, census).collect()}
    assert got == {1: (1, "1", None), 2: (2, None, "not_exactly_one"), 3: (1, "3", "shared_code"), 4: (1, "3", "shared_code"), 5: (0, None, "not_exactly_one")}


def test_redirect_paths(spark):
    """Chains of every length around the limit, a loop, a lost page, a hot login page."""
    hops = [(f"http://h/{i}", 301, f"/{i - 1}") for i in range(1, 9)] + [("http://h/0", 200, None)]
    hops += [("http://h/a", 302, "/b"), ("http://h/b", 302, "/a"), ("http://h/lost", 301, "/none"), ("http://h/blank", 308, " "),
             ("http://h/login", 200, "/ignored")]
    hops += [(f"http://h/u{i}", 302, "/login") for i in range(500)]
    log = spark.createDataFrame(hops, "url string, status_code int, location string")
    asked = ["http://h/%d" % i for i in range(9)] + ["http://h/a", "http://h/lost", "http://h/blank", None, "http://h/x"] + [f"http://h/u{i}" for i in range(500)] * 2
    requests = spark.createDataFrame(list(enumerate(asked)), "id long, url string")
    table = {u: (c, loc) for u, c, loc in hops}

    def follow(url):
        chain = []
        while True:
            if url not in table:
                return None, None, chain, "not_fetched"
            code, target = table[url]
            if code == 200:
                return code, url, chain, None
            if not target.strip():
                return code, None, chain, "redirect_without_location"
            if len(chain) == 5:
                return code, None, chain, "too_many_redirects"
            url = "http://h" + target
            chain.append(url)

    got = {r["id"]: tuple(r)[1:] for r in audit.resolve_redirects(requests, log).collect()}
    assert got == {i: follow(u) for i, u in enumerate(asked)}
    assert audit.resolve_redirects(requests, log.limit(0)).filter("error_code <> 'not_fetched'").count() == 0


def test_sources_are_resolved_once(spark, monkeypatch):
    wanted = spark.createDataFrame(
        [(7, "a", "https://a.example", []), (7, "b", "https://b.example", ["old b"]), (8, "c", "https://c.example", [])],
        "institution_id long, catalog_source_id string, url string, replaces array<string>",
    )
    rows = [(1, 7, "a", "x", "https://z.example"), (2, 7, None, "Old B", "https://y.example"), (3, 8, "other", "w", "https://c.example")]
    existing = spark.createDataFrame(rows, "id long, institution_id long, catalog_source_id string, name string, url string")
    matches, conflicts = upsert.resolve_sources(wanted, existing.withColumn("normalized_url", F.col("url")))
    assert sorted(tuple(r) for r in matches.collect()) == [("a", 1, False), ("b", 2, True)]
    assert [tuple(r) for r in conflicts.collect()] == [("c", "url_owned_by_other_id")]
    # what callers join several times is read, not derived again
    plan = matches._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    calls = []
    resolve = upsert.resolve_sources
    monkeypatch.setattr(upsert, "resolve_sources", lambda *a: calls.append(a) or resolve(*a))
    all_queries()[0]["e08_source_conflicts"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_sources_that_share_a_key_stay_linear(spark):
    """Two hundred registry rows and two hundred wishes on one URL: one certificate, no pairs."""
    rows = [(i, 1, None, f"n{i}", "https://São.example/", None) for i in range(200)] + [(900, 1, None, "Only Ône", "https://b.example", None)]
    registry = spark.createDataFrame(rows, "id long, institution_id long, catalog_source_id string, name string, url string, normalized_url string")
    wishes = [(1, f"w{i}", "https://xn--so-sia.example", []) for i in range(200)] + [
        (1, "by-name", "https://new.example", ["only  one"]), (1, "both", "https://b.example", ["N7"]), (2, "other", "https://b.example", [])]
    wanted = spark.createDataFrame(wishes, "institution_id long, catalog_source_id string, url string, replaces array<string>")
    matches, conflicts = upsert.resolve_sources(wanted, registry)
    assert {tuple(r) for r in matches.collect()} == {("by-name", 900, True)}
    assert sorted(tuple(r) for r in conflicts.collect()) == sorted(
        [(f"w{i}", "url_matches_several") for i in range(200)] + [("both", "url_and_replaces_disagree")])


def test_legacy_tokens_count_a_row_once(spark):
    """A census row that holds both tokens of a legacy row is one candidate, hot tokens add up."""
    census = spark.createDataFrame([(str(i), None, "Hot", "Universidade Ú" if i % 2 else f"u {i}", "SP") for i in range(100)],
                                   "official_code string, official_initials string, initials string, official_name string, state string")
    rows = spark.createDataFrame([(1, "universidade u", "HOT", "SP"), (2, "u 4", "hot", "sp"), (3, "u 4", "zz", "sp"), (4, "Hot", "hot", "SP")],
                                 "legacy_id long, name string, initials string, state string")
    got = {r["legacy_id"]: (r["candidates"], r["official_code"]) for r in legacy.match_legacy(rows, census).collect()}
    assert got == {1: (100, None), 2: (100, None), 3: (1, "4"), 4: (100, None)}


def test_parts_are_spread_over_the_cores(spark):
    # One small file is one scan partition; addresses and names built from it keep a core busy.
    parts = Tables(spark, "/root/testdata/sf0.01")
    assert parts.part.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert parts.part.count() == spark.read.parquet("/root/testdata/sf0.01/part.parquet").count()


def test_shared_rules_meet_notices_in_lists(spark, monkeypatch):
    # Shared and rare rules, users with one and with several rules, a copied notice, known and foreign outbox rows.
    monkeypatch.setattr(alerts, "PACK", 3)
    rng = random.Random(5)
    rules = [(i, rng.randrange(60) if i < 40 else 100 + i, rng.choice(("ab", "c")), rng.choice((None, None, None, 1, 2)),
              rng.choice((None, None, "x")), i % 9 != 0) for i in range(120)]
    notices = [(n % 30, n % 3, rng.choice("xy"), rng.choice(("ab", "abc", "q", "C")), None, True) for n in range(31)]
    told = [(rng.choice(rules)[1], rng.randrange(40)) for _ in range(400)]
    rule_rows = spark.createDataFrame(rules, "id long, user_id long, keyword string, institution_id long, notice_type string, is_active boolean")
    notice_rows = spark.createDataFrame(notices, "id long, institution_id long, notice_type string, title string, description string, is_active boolean")
    outbox = spark.createDataFrame(told, "user_id long, notice_id long")
    found = [(a, u, n) for a, u, k, i, t, on in rules if on for n, ni, nt, title, *_ in notices
             if k in title.lower() and i in (None, ni) and t in (None, nt)]
    assert sorted(tuple(r) for r in alerts.match_alerts(rule_rows, notice_rows).collect()) == sorted(found)
    pairs = {(u, n) for _, u, n in found}
    hits = alerts.alert_hits(rule_rows, notice_rows)
    assert sorted(tuple(r) for r in alerts.matched_pairs(rule_rows, hits).collect()) == sorted(pairs)
    fresh = alerts.unsent_pairs(rule_rows, hits, outbox)
    assert sorted((r["user_id"], r["notice_id"]) for r in fresh.collect()) == sorted(pairs - set(told))
    (stats,) = alerts.match_stats(rule_rows, hits, alerts.count_unsent(rule_rows, hits, outbox)).collect()
    assert (stats["notices_checked"], stats["notifications_created"]) == (len(found), len(pairs - set(told)))


def test_lists_of_users_are_not_shuffled_with_notices(spark, monkeypatch):
    # Nothing is small enough to be sent: what is shuffled by notice are keys, lists are joined after that.
    monkeypatch.setattr(alerts, "SENT_BYTES", 0)
    rules = spark.createDataFrame([(i, i, "ab", None, None, True) for i in range(40)] + [(99, 5, "b", 1, None, True)],
                                  "id long, user_id long, keyword string, institution_id long, notice_type string, is_active boolean")
    notices = spark.createDataFrame([(n, n % 2, "x", "ab", None, True) for n in range(6)],
                                    "id long, institution_id long, notice_type string, title string, description string, is_active boolean")
    outbox = spark.createDataFrame([(u, u % 7) for u in range(50)] + [(None, 3)], "user_id long, notice_id long")
    fresh = alerts.unsent_pairs(rules, alerts.alert_hits(rules, notices), outbox)
    lines = fresh._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "Exchange" in line and "notice_id" in line:
            below = list(itertools.takewhile(lambda other: depth(other) > depth(line), lines[i + 1 :]))
            assert not any("members" in other for other in below)
    got = sorted((r["user_id"], r["notice_id"]) for r in fresh.collect())
    assert got == sorted((u, n) for u in range(40) for n in range(6) if n != u % 7)


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    # 600 rows of 40,000 characters: by the number of rows alone two batches.
    Tables(spark, "/root/testdata/sf0.001")
    long = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("é"), 40_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes], pa.int64())], ["n"])

    found = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 600 * 80_000 and max(found) <= 3 * ARROW_BYTES


def test_both_channel_results_read_posts_extracted_once(spark):
    api = spark.createDataFrame([(1, "t", "u", "edital", None, 0, 0)], "source_id long, title string, url string, notice_type string, description string, term_order int, pos int")
    api = api.mapInArrow(lambda batches: batches, api.schema)  # stands for the costly extraction
    page = spark.createDataFrame([(1, "p", "u", "edital", None, 0), (2, "q", "v", "edital", None, 1)], "source_id long, title string, url string, notice_type string, description string, pos int")
    items, failed = posts.merge_channels(api, page, spark.createDataFrame([(1,), (3,)], "source_id long"))
    for df in (items, failed):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["source_id"], r["title"]) for r in items.collect()) == [(1, "t"), (2, "q")]
    assert [r["source_id"] for r in failed.collect()] == [3]


def test_hits_are_dealt_out_before_rules_are_opened(spark):
    # Hits are few bytes and many pairs: tasks are not cut by the size of their file, and pairs are not shuffled.
    rules = spark.createDataFrame([(i, i, ("ab", "c", "q")[i % 3], None, None, True) for i in range(60)],
                                  "id long, user_id long, keyword string, institution_id long, notice_type string, is_active boolean")
    notices = spark.createDataFrame([(n, 1, "x", ("ab", "abc", "z")[n % 3], None, True) for n in range(9)],
                                    "id long, institution_id long, notice_type string, title string, description string, is_active boolean")
    found = alerts.match_alerts(rules, notices, shard_keywords=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({2 * spark.sparkContext.defaultParallelism})" in plan
    assert "Exchange" not in plan[: plan.index("Join")]
    assert sorted((r["user_id"], r["notice_id"]) for r in found.collect()) == sorted(
        (i, n) for i in range(60) for n in range(9) if ("ab", "c", "q")[i % 3] in ("ab", "abc", "z")[n % 3])


def test_page_frontier_parses_pages_once(spark):
    # Frontier and items read links that are written: no parser and no page below the folding steps.
    items = all_queries()[0]["p17_page_frontier"](spark, "/root/testdata/sf0.001")
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" in plan


@pytest.mark.parametrize("name", ["a15_probe_pages", "a18_audit_sources"])
def test_probes_bring_no_page_text_out_of_the_parser(spark, name):
    plan = all_queries()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    (parsed,) = [line for line in plan.splitlines() if "MapInPandas" in line]
    assert "link_count" in parsed and "body_text" not in parsed


def test_written_keys_are_not_sent_by_the_size_of_their_files(spark, monkeypatch):
    from noticeflow import session
    from noticeflow.operators import upsert

    keys = session.materialize(spark.range(400_000).select((F.col("id") * 0 + F.col("id")).alias("id")), "keys")
    plan = lambda: spark.range(10**9).join(keys, "id")._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan() and "BroadcastHashJoin" not in session.joins_by_rows(plan)()
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    seen = []

    def watched(df, name):
        seen.append((name, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")))
        return session.materialize(df, name)

    monkeypatch.setattr(upsert, "materialize", watched)
    wanted = spark.createDataFrame([(1, "a", "https://h.example/a", [])], "institution_id long, catalog_source_id string, url string, replaces array<string>")
    rows = spark.createDataFrame([(7, 1, "a", "n", "https://h.example/a", None)], "id long, institution_id long, catalog_source_id string, name string, url string, normalized_url string")
    matches, conflicts = upsert.resolve_sources(wanted, rows)
    assert [tuple(r) for r in matches.collect()] == [("a", 7, False)] and conflicts.count() == 0
    assert len(seen) == 4 and {size for _, size in seen} == {"-1"}
