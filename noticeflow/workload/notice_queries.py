"""Q, M and O rows: searches, alert matching, outbox, crawl operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.functions import text
from noticeflow.operators import alerts, crawl_ops, queries
from noticeflow.session import materialize, scratch_path
from noticeflow.sources import sinks
from noticeflow.streaming import jobs
from noticeflow.workload.registry import query
from noticeflow.workload.scalar_queries import sql_message


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def sql_stamp(name, alias=None):
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {alias or name}"


# ---------------------------------------------------------------- searches

_SEARCH = """ntc WHERE is_active AND (title ILIKE '%th_ %' OR description ILIKE '%th_ %')
  AND institution_id IN (SELECT id FROM inst WHERE state = 'NATION_3') AND notice_type = 'edital'
  AND detected_at >= TIMESTAMP '2024-01-01 00:05:00' AND detected_at <= TIMESTAMP '2030-01-01 00:00:00'"""


@query("q01_search_notices", f"SELECT id, title, {sql_stamp('detected_at')} FROM {_SEARCH} ORDER BY ntc.detected_at DESC, id LIMIT 50 OFFSET 3")
def _(t):
    found = queries.search_notices(
        t.ntc, t.inst, keyword="th_ ", state="NATION_3", notice_type="edital",
        detected_after="2024-01-01 00:05:00", detected_before="2030-01-01 00:00:00", skip=3, limit=50,
    )
    return found.select("id", "title", stamp("detected_at"))


@query("q02_notice_detail", """
SELECT ntc.id, institution_id, title, ntc.url, notice_type, inst.name AS institution_name, initials AS institution_initials, state AS institution_state
FROM ntc LEFT JOIN inst ON inst.id = institution_id WHERE ntc.is_active AND ntc.id IN (SELECT notice_id FROM ntf WHERE status = 'pending')""")
def _(t):
    opened = t.ntf.filter("status = 'pending'").select(F.col("notice_id").alias("id")).distinct()
    found = queries.notice_detail(t.ntc, t.inst, opened)
    return found.select("id", "institution_id", "title", "url", "notice_type", "institution_name", "institution_initials", "institution_state")


@query("q03_list_institutions", """
SELECT 'review' AS list, id FROM inst WHERE NOT (source_discovery_status = 'manual_review' OR contains(eligibility_status, 'manual_review'))
  AND id IN (SELECT institution_id FROM src WHERE is_active) AND is_active
UNION ALL SELECT 'manual', id FROM inst WHERE source_discovery_status = 'manual_review' OR contains(eligibility_status, 'manual_review')
UNION ALL SELECT 'bare', id FROM inst WHERE id NOT IN (SELECT institution_id FROM src WHERE coverage_status = 'verified' AND priority_size < 3)
UNION ALL SELECT 'region', id FROM inst WHERE region = 'ASIA' AND administrative_category_code = 1 AND eligibility_status = 'included'""")
def _(t):
    lists = {
        "review": queries.list_institutions(t.inst, t.src.filter("is_active"), manual_review=False, has_source=True, is_active=True, limit=None),
        "manual": queries.list_institutions(t.inst, manual_review=True, limit=None),
        "bare": queries.list_institutions(t.inst, t.src.filter("coverage_status = 'verified' AND priority_size < 3"), has_source=False, limit=None),
        "region": queries.list_institutions(t.inst, region="ASIA", administrative_category_code=1, eligibility_status="included", limit=None),
    }
    parts = [df.select(F.lit(name).alias("list"), "id") for name, df in lists.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("q04_list_sources", """
SELECT 'plain' AS list, id FROM src WHERE coverage_status = 'verified' AND is_active
UNION ALL SELECT 'clear', src.id FROM src JOIN inst ON inst.id = institution_id
  WHERE coverage_status IS DISTINCT FROM 'manual_review' AND source_discovery_status <> 'manual_review' AND NOT contains(eligibility_status, 'manual_review')
UNION ALL SELECT 'state', src.id FROM src JOIN inst ON inst.id = institution_id WHERE state = 'NATION_7' AND inst.is_active""")
def _(t):
    plain = queries.list_sources(t.src, t.inst, verification_status="verified", source_active=True, limit=None)
    clear = queries.list_sources(t.src, t.inst, manual_review=False, limit=None)
    state = queries.list_sources(t.src, t.inst, state="nation_7", institution_active=True, limit=None)
    tag = lambda df, name: df.select(F.lit(name).alias("list"), "id")
    return tag(plain, "plain").unionAll(tag(clear, "clear")).unionAll(tag(state, "state"))


@query("q05_user_pages", """
SELECT 'alert' AS kind, id, keyword AS what FROM alr WHERE user_id = 7
UNION ALL SELECT 'notification', id, status FROM (SELECT * FROM ntf WHERE user_id = 7 ORDER BY id LIMIT 50)
UNION ALL SELECT 'detail', ntf.id, title FROM ntf LEFT JOIN ntc ON ntc.id = notice_id WHERE ntf.id = (SELECT min(id) FROM ntf WHERE user_id = 7) AND user_id = 7""")
def _(t):
    first = t.ntf.filter("user_id = 7").agg(F.min("id")).first()[0]
    detail = queries.notification_detail(t.ntf, t.ntc, 7, first)
    row = lambda df, kind, what: df.select(F.lit(kind).alias("kind"), "id", F.col(what).alias("what"))
    return row(queries.user_alerts(t.alr, 7), "alert", "keyword").unionAll(
        row(queries.user_notifications(t.ntf, 7), "notification", "status")
    ).unionAll(row(detail, "detail", "title"))


@query("q06_scoped_sources", """
SELECT src.id, initials, src.name FROM src JOIN inst ON inst.id = institution_id
WHERE src.is_active AND inst.is_active AND initials IN ('I1', 'I2', 'I17')""")
def _(t):
    found = queries.scoped_sources(t.src, t.inst, ["I1", "I2", "I17"])
    return found.select("id", F.col("institution_initials").alias("initials"), "name")


# ---------------------------------------------------------------- alerts and outbox

_RULE = """alr.is_active AND ntc.is_active AND (title ILIKE '%' || keyword || '%' OR description ILIKE '%' || keyword || '%')
  AND (alr.institution_id IS NULL OR alr.institution_id = ntc.institution_id)
  AND (alr.notice_type IS NULL OR alr.notice_type = ntc.notice_type)"""
_MATCH = f"SELECT alr.id AS alert_id, user_id, ntc.id AS notice_id FROM alr JOIN ntc ON {_RULE}"


@query("m01_validate_alerts", """
SELECT alr.id, keyword, CASE WHEN keyword = '' THEN 'empty_keyword'
  WHEN alr.institution_id IS NOT NULL AND NOT coalesce(inst.is_active, false) THEN 'institution_unavailable' END AS reason
FROM (SELECT id, CASE WHEN keyword = 'los' THEN '' ELSE keyword END AS keyword, CASE WHEN id % 50 = 1 THEN -1 ELSE institution_id END AS institution_id FROM alr) alr
LEFT JOIN inst ON inst.id = alr.institution_id""")
def _(t):
    raw = t.alr.select(
        "id",
        F.when(F.col("keyword") == "los", F.lit(" \t")).otherwise(F.concat(F.lit(" "), "keyword", F.lit("\n"))).alias("keyword"),
        F.when(F.col("id") % 50 == 1, F.lit(-1)).otherwise(F.col("institution_id")).alias("institution_id"),
    )
    return alerts.validate_alerts(raw, t.inst).select("id", "keyword", "reason")


@query("m02_match_alerts", _MATCH)
def _(t):
    return alerts.match_alerts(t.alr, t.ntc)


@query("m02_match_alerts_large_vocabulary", _MATCH)
def _(t):
    # the same result when the vocabulary is cut into many automata
    return alerts.match_alerts(t.alr, t.ntc, shard_keywords=5)


_NEW = f"""SELECT DISTINCT user_id, notice_id FROM ({_MATCH}) m
  WHERE NOT EXISTS (SELECT 1 FROM ntf WHERE ntf.user_id = m.user_id AND ntf.notice_id = m.notice_id)"""


@query("m03_new_notifications", f"SELECT user_id, notice_id, 'pending' AS status FROM ({_NEW})")
def _(t):
    hits = materialize(alerts.alert_hits(t.alr, t.ntc), "hits")
    return alerts.unsent_pairs(t.alr, hits, t.ntf).select("user_id", "notice_id", "status")


@query("m04_match_stats", f"""
SELECT (SELECT count(*) FROM alr WHERE is_active) AS alerts_checked, (SELECT count(*) FROM ({_MATCH})) AS notices_checked,
  (SELECT count(*) FROM ({_NEW})) AS notifications_created,
  (SELECT count(*) FROM ({_MATCH})) - (SELECT count(*) FROM ({_NEW})) AS duplicates_skipped""")
def _(t):
    hits = materialize(alerts.alert_hits(t.alr, t.ntc), "hits")
    return alerts.match_stats(t.alr, hits, alerts.count_unsent(t.alr, hits, t.ntf))


_MESSAGE = sql_message("coalesce(title, '')", "ntc.notice_type", "coalesce(nullif(description, ''), 'Sem descrição')", "ntc.url")


@query("m05_dispatch_batch", f"""
SELECT b.id, CASE WHEN usr.id IS NULL OR ntc.id IS NULL THEN 'failed' ELSE 'ready' END AS status,
  CASE WHEN usr.id IS NULL OR ntc.id IS NULL THEN 'Missing user or notice relation' END AS error_message,
  CASE WHEN usr.id IS NOT NULL AND ntc.id IS NOT NULL THEN email END AS email,
  CASE WHEN usr.id IS NOT NULL AND ntc.id IS NOT NULL THEN 'Novo Edital Encontrado: ' || title END AS subject,
  CASE WHEN usr.id IS NOT NULL AND ntc.id IS NOT NULL THEN sha256({_MESSAGE}) END AS body
FROM (SELECT * FROM ntf WHERE status = 'pending' ORDER BY id LIMIT 50) b
LEFT JOIN usr ON usr.id = b.user_id LEFT JOIN ntc ON ntc.id = b.notice_id""")
def _(t):
    batch = alerts.dispatch_batch(t.ntf, t.usr, t.ntc, 50)
    return batch.select("id", "status", "error_message", "email", "subject", F.sha2("body", 256).alias("body"))


@query("m06_apply_delivery", f"""
SELECT ntf.id, CASE WHEN ntf.status = 'pending' THEN CASE WHEN c_acctbal < 1000 THEN 'failed' ELSE 'sent' END ELSE ntf.status END AS status,
  {sql_stamp("CASE WHEN ntf.status = 'pending' AND c_acctbal >= 1000 THEN TIMESTAMP '2024-01-20 00:00:00' ELSE sent_at END", 'sent_at')},
  CASE WHEN ntf.status = 'pending' THEN CASE WHEN c_acctbal < 1000 THEN substr(repeat(c_name, 40), 1, 255) END ELSE error_message END AS error_message
FROM ntf JOIN customer ON c_custkey = user_id""")
def _(t):
    people = t.customer.select(F.col("c_custkey").alias("user_id"), "c_acctbal", "c_name")
    results = t.ntf.join(people, "user_id").select(
        "id", F.when(F.col("c_acctbal") < 1000, F.expr("repeat(c_name, 40)")).alias("error_message")
    )
    done = alerts.apply_delivery(t.ntf, results, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return done.select("id", "status", stamp("sent_at"), "error_message")


@query("m06_delivery_counts", """
SELECT count(*) FILTER (WHERE c_acctbal >= 1000) AS sent, count(*) FILTER (WHERE c_acctbal < 1000) AS failed
FROM ntf JOIN customer ON c_custkey = user_id WHERE status = 'pending'""")
def _(t):
    people = t.customer.select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    results = t.ntf.filter("status = 'pending'").join(people, "user_id").select(
        "id", F.when(F.col("c_acctbal") < 1000, F.lit("bounced")).alias("error_message")
    )
    return alerts.delivery_counts(results)


@query("m07_stream_matching", f"SELECT user_id, notice_id, 1 AS copies FROM (SELECT DISTINCT user_id, notice_id FROM ({_MATCH}))")
def _(t):
    root = scratch_path(t.spark, "stream")
    # Two deliveries, the second repeating the first: a pair is stored once.
    read = t.ntc.select("id", "institution_id", "notice_type", "title", "description", "is_active")
    for _ in ("a", "b"):
        sinks.append(read.coalesce(2), f"{root}/notices")
    stream = t.spark.readStream.schema(read.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/notices")
    jobs.start_matching(t.spark, stream, t.alr, f"{root}/outbox", f"{root}/state").awaitTermination()
    stored = jobs.stored_copies(t.spark, f"{root}/outbox")
    return stored.select("user_id", "notice_id", F.col("copies").cast("int").alias("copies"))


# ---------------------------------------------------------------- crawl operations

_LATEST = "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 1"
_HEALTH = """CASE WHEN NOT src.is_active THEN 'inactive' WHEN last_checked_at IS NULL AND r.id IS NULL THEN 'never_checked'
  WHEN coalesce(last_error_message, '') <> '' OR r.status = 'failed' THEN 'error'
  WHEN r.status = 'completed' AND coalesce(items_found, 0) = 0 THEN 'warning' ELSE 'ok' END"""


@query("o01_latest_runs", f"SELECT id, source_id, status FROM ({_LATEST})")
def _(t):
    return crawl_ops.latest_runs(t.runs).select("id", "source_id", "status")


@query("o02_source_health", f"SELECT src.id, {_HEALTH} AS health_status FROM src LEFT JOIN ({_LATEST}) r ON r.source_id = src.id")
def _(t):
    return crawl_ops.source_health(t.src, t.runs).select("id", "health_status")


@query("o03_sources_status", f"""
SELECT src.id AS source_id, src.name AS source_name, inst.name AS institution_name, initials AS institution_initials,
  {_HEALTH} AS health_status, r.id AS run_id, {sql_stamp('r.started_at', 'started_at')}
FROM src JOIN inst ON inst.id = institution_id LEFT JOIN ({_LATEST}) r ON r.source_id = src.id""")
def _(t):
    sheet = crawl_ops.sources_status(t.src, t.inst, t.runs)
    return sheet.select("source_id", "source_name", "institution_name", "institution_initials", "health_status",
                        F.col("run.id").alias("run_id"), F.date_format("run.started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query("o04_crawler_status", f"""
SELECT count(*) AS total_sources, count(*) FILTER (WHERE is_active) AS active_sources,
  {", ".join(f"count(*) FILTER (WHERE h = '{h}') AS {h}_sources" for h in crawl_ops.HEALTH)},
  (SELECT count(*) FROM ntc WHERE is_active) AS total_active_notices,
  (SELECT id FROM runs ORDER BY started_at DESC, id DESC LIMIT 1) AS last_run_id,
  (SELECT coalesce(items_found, 0) FROM runs ORDER BY started_at DESC, id DESC LIMIT 1) AS last_run_items_found,
  (SELECT coalesce(new_items, 0) FROM runs ORDER BY started_at DESC, id DESC LIMIT 1) AS last_run_new_items
FROM (SELECT src.is_active, {_HEALTH} AS h FROM src JOIN inst ON inst.id = institution_id LEFT JOIN ({_LATEST}) r ON r.source_id = src.id)""")
def _(t):
    return crawl_ops.crawler_status(t.src, t.inst, t.runs, t.ntc)


@query("o05_run_history", f"""
SELECT runs.id, source_id, status, coalesce(items_found, 0) AS items_found, coalesce(new_items, 0) AS new_items,
  src.name AS source_name, initials AS institution_initials, {sql_stamp('started_at')}
FROM runs JOIN src ON src.id = source_id JOIN inst ON inst.id = institution_id
ORDER BY runs.started_at DESC, runs.id DESC LIMIT 50 OFFSET 20""")
def _(t):
    history = crawl_ops.run_history(t.runs, t.src, t.inst, 20, 50)
    return history.select("id", "source_id", "status", "items_found", "new_items", "source_name", "institution_initials", stamp("started_at"))
