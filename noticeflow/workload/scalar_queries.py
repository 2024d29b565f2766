"""T rows: scalar functions over whole columns of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from noticeflow.functions import text, urls, values
from noticeflow.lexicon import Lexicon
from noticeflow.workload.registry import query

# Test vocabulary: frequent fragments of the synthetic text.
LEX = Lexicon(
    keywords=("thre", "que", "der", "ment", "ción"),
    tender_pattern=r"\bth(?:at|is|e)\b",
    type_rules=(
        ("ción", "retificacao"), ("ment", "resultado"), ("sch", "homologacao"),
        (r"\bth(?:at|is)\b", "licitacao"), ("eau", "concurso"), ("ing", "bolsa"), ("er", "pregao"),
    ),
    generic_link_texts=("the", "la", "de", "der", "and"),
    listing_titles=("of", "en", "os", "des"),
    next_markers=("an", "et"),
    strong_keywords=("sch", "ción"),
    broad_keywords=("the", "que"),
    confirmations=("and the", "de la", "le "),
)
# The folded form of the test vocabulary, as matched against folded text.
FOLDED = Lexicon(**{**LEX.__dict__, "keywords": ("thre", "que", "der", "ment", "cion"),
                    "type_rules": (("cion", "retificacao"), *LEX.type_rules[1:]),
                    "strong_keywords": ("sch", "cion")})

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


def sql_squash(x):
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g'))"


def sql_fold(x):
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '{WS}', ' ', 'g'))"


def sql_casefold(x):
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_truncate(x, n):
    return (
        f"CASE WHEN {x} = '' THEN NULL WHEN length({x}) <= {n} THEN {x} "
        f"ELSE regexp_replace(substr({x}, 1, {n - 3}), '{WS}$', '') || '...' END"
    )


def sql_keyword(folded):
    tests = [f"contains({folded}, '{k}')" for k in FOLDED.keywords]
    return "(" + " OR ".join([*tests, rf"regexp_matches({folded}, '\bth(?:at|is|e)\b')"]) + ")"


def sql_type(folded):
    whens = []
    for fragment, kind in FOLDED.type_rules:
        test = f"regexp_matches({folded}, '{fragment}')" if "\\" in fragment else f"contains({folded}, '{fragment}')"
        whens.append(f"WHEN {test} THEN '{kind}'")
    return "CASE " + " ".join(whens) + " ELSE 'edital' END"


def sql_canonical(x):
    """Absolute test URLs: simple enough for one regular expression per part."""
    query_text = f"regexp_extract({x}, '\\?([^#]*)', 1)"
    kept = (
        f"array_to_string(list_sort(list_filter(string_split({query_text}, '&'), "
        "lambda q: q <> '' AND NOT regexp_matches(q, '^utm_'))), '&')"
    )
    path = f"regexp_extract({x}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    shown = f"CASE WHEN {path} = '' THEN '/' WHEN length({path}) > 1 THEN rtrim({path}, '/') ELSE {path} END"
    return (
        f"regexp_extract({x}, '^([a-z]+://)', 1) || lower(regexp_extract({x}, '^[a-z]+://([^/?#]*)', 1)) || "
        f"{shown} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"
    )


def hashed(t, name, expr):
    return t.documents.select("doc_id", F.sha2(expr, 256).alias(name))


def hashed_sql(name, expr):
    return f"SELECT doc_id, sha256({expr}) AS {name} FROM documents"


@query("t01_normalize_title", hashed_sql("title", f"lower({sql_squash('text')})"))
def _(t):
    return hashed(t, "title", text.normalize_title(F.col("text")))


@query("t02_fold_text", hashed_sql("folded", sql_fold("text")))
def _(t):
    return hashed(t, "folded", text.fold_text(F.col("text")))


_HTML_TEXT = (
    "replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
    "'(?s)<!--.*?-->', ' ', 'g'), '(?s)<script.*?</script>', ' ', 'g'), "
    "'(?s)<style.*?</style>', ' ', 'g'), '(?s)<[/!]?[A-Za-z][^>]*>', ' ', 'g'), "
    "'&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
)


@query("t03_clean_text", f"SELECT page_id, sha256({sql_squash(_HTML_TEXT)}) AS cleaned FROM pages")
def _(t):
    return t.pages.select("page_id", F.sha2(text.clean_text(F.col("html")), 256).alias("cleaned"))


@query("t04_fix_mojibake", "SELECT doc_id, sha256(text) AS repaired FROM documents")
def _(t):
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return hashed(t, "repaired", text.fix_mojibake(garbled))


@query("t05_truncate", f"SELECT doc_id, {sql_truncate('text', 240)} AS short FROM documents")
def _(t):
    return t.documents.select("doc_id", text.truncate(F.col("text"), 240).alias("short"))


@query("t06_canonical_url", f"SELECT page_id, {sql_canonical('url')} AS canonical FROM pages")
def _(t):
    return t.pages.select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(
    "t07_catalog_url",
    "SELECT page_id, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '/+$', '') "
    "|| coalesce(regexp_extract(url, '\\?[^#]*', 0), '') AS url, CAST(NULL AS VARCHAR) AS error FROM pages "
    "UNION ALL SELECT page_id, NULL, 'credentials' FROM pages",
)
def _(t):
    parsed = F.explode(F.array(
        urls.catalog_url(F.col("url")),
        urls.catalog_url(F.regexp_replace("url", "://", "://user@")),
    )).alias("c")
    return t.pages.select("page_id", parsed).select("page_id", "c.url", "c.error")


@query("t08_fingerprint", "SELECT id, fingerprint FROM ntc")
def _(t):
    return t.ntc.select("id", urls.fingerprint(
        F.col("institution_id"), F.col("normalized_title"), F.col("normalized_url")
    ).alias("fingerprint"))


_RAW_TYPE = (
    "CASE p_type WHEN 'STANDARD' THEN ' Seleção' WHEN 'MEDIUM' THEN 'processo-seletivo' "
    "WHEN 'ECONOMY' THEN 'Pregão ' WHEN 'PROMO' THEN p_name WHEN 'SMALL' THEN NULL ELSE 'PROCESSO  SELETIVO' END"
)


@query(
    "t09_normalize_notice_type",
    "SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'processo_seletivo' WHEN 'MEDIUM' THEN 'processo_seletivo' "
    "WHEN 'ECONOMY' THEN 'pregao' WHEN 'LARGE' THEN 'processo_seletivo' ELSE 'edital' END AS notice_type FROM part",
)
def _(t):
    return t.part.select("p_partkey", text.normalize_notice_type(F.expr(_RAW_TYPE)).alias("notice_type"))


@query("t10_infer_notice_type", f"SELECT doc_id, {sql_type('f')} AS notice_type FROM (SELECT doc_id, {sql_fold('text')} AS f FROM documents)")
def _(t):
    return t.documents.select("doc_id", text.infer_notice_type(F.col("text"), FOLDED).alias("notice_type"))


@query("t11_has_keyword", f"SELECT doc_id, {sql_keyword('f')} AS hit FROM (SELECT doc_id, {sql_fold('text')} AS f FROM documents)")
def _(t):
    return t.documents.select("doc_id", text.has_keyword(F.col("text"), FOLDED).alias("hit"))


@query("t12_identity_token", hashed_sql(
    "token", sql_casefold("regexp_replace(strip_accents(text), '[^\\p{L}\\p{N}]', '', 'g')")))
def _(t):
    return hashed(t, "token", text.identity_token(F.col("text")))


_SLUG = (
    "coalesce(nullif(substr(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}), "
    "'[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'source')"
)


@query("t13_stable_source_id",
       "SELECT doc_id, {s} AS slug, 'inep-' || CAST(doc_id AS VARCHAR) || '-' || {s} || '-' || "
       "substr(sha256(source), 1, 10) AS source_id FROM documents".format(s=_SLUG.format(x="text")))
def _(t):
    return t.documents.select(
        "doc_id",
        text.slug(F.col("text")).alias("slug"),
        text.stable_source_id(F.col("doc_id").cast("string"), F.col("text"), F.col("source")).alias("source_id"),
    )


@query("t14_domain_family",
       "SELECT page_id, l[-2] || '.' || l[-1] AS family, l[-1] || '.gov.br' AS br_family FROM "
       "(SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.') AS l FROM pages)")
def _(t):
    host = urls.host_of(F.col("url"))
    return t.pages.select(
        "page_id",
        urls.domain_family(host).alias("family"),
        urls.domain_family(F.concat(host, F.lit(".gov.br"))).alias("br_family"),
    )


@query("t15_mime_essence", "SELECT doc_id, 'text/' || lang AS essence FROM documents")
def _(t):
    return t.documents.select("doc_id", values.mime_essence(
        F.concat(F.lit(" Text/"), F.upper("lang"), F.lit(" ; charset="), F.col("source"))
    ).alias("essence"))


@query("t16_squash", f"SELECT doc_id, sha256({sql_squash('text')}) AS squashed, "
                     f"sha256({sql_casefold(sql_squash('text'))}) AS key FROM documents")
def _(t):
    return t.documents.select(
        "doc_id",
        F.sha2(text.squash(F.col("text")), 256).alias("squashed"),
        F.sha2(text.squash_fold(F.col("text")), 256).alias("key"),
    )


@query("t17_percent", """
SELECT l_partkey, round_even(n * 100.0::DOUBLE / total, 2) AS pct, 0.0::DOUBLE AS none FROM (
  SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n, count(*) AS total FROM lineitem GROUP BY l_partkey)""")
def _(t):
    counts = t.lineitem.groupBy("l_partkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n"), F.count("*").alias("total")
    )
    return counts.select(
        "l_partkey",
        values.percent(F.col("n"), F.col("total")).alias("pct"),
        values.percent(F.col("n"), F.lit(0)).alias("none"),
    )


_PATH = "lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1))"


@query("t18_is_document_url",
       f"SELECT page_id, regexp_matches({_PATH}, '\\.html$') AS html_page, "
       f"regexp_matches(rtrim({_PATH}, '/'), '\\.(html|org)$') AS audit_page, "
       "true AS pdf FROM pages")
def _(t):
    url = F.col("url")
    pdf = F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/a.PDF?x=1#y"))
    return t.pages.select(
        "page_id",
        urls.is_document_url(url, ("html",)).alias("html_page"),
        urls.is_audit_document(url, ("html", "org")).alias("audit_page"),
        urls.is_document_url(pdf).alias("pdf"),
    )


def sql_escape(x):
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


def sql_message(title, kind, description, url):
    parts = []
    marks = {"{title}": title, "{type}": kind, "{description}": description, "{url}": url}
    for line in text._BODY_LINES:
        sql = "'" + line.replace("'", "''") + "'"
        for mark, value in marks.items():
            sql = sql.replace(mark, "' || " + sql_escape(value) + " || '")
        parts.append(sql)
    return "(" + " || chr(10) || ".join(parts) + ")"


@query("t19_render_message",
       f"SELECT page_id, sha256({sql_escape('html')}) AS escaped, "
       f"sha256({sql_message('html', chr(39) + 'edital' + chr(39), chr(39) + 'Sem descrição' + chr(39), 'url')}) AS body FROM pages")
def _(t):
    body = text.render_message(F.col("html"), F.lit("edital"), F.lit(None).cast("string"), F.col("url"))
    return t.pages.select(
        "page_id",
        F.sha2(text.html_escape(F.col("html")), 256).alias("escaped"),
        F.sha2(body, 256).alias("body"),
    )


@query("t20_coerce_value", """
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS at,
  strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey AS number, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS items,
  true AS same, o_orderstatus = 'F' AS same_null FROM orders""")
def _(t):
    stamp = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss")
    at = values.coerce_value(F.concat(stamp, F.lit("-03:00")), T.TimestampType())
    utc = values.coerce_value(F.concat(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), T.TimestampType())
    missing = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return t.orders.select(
        "o_orderkey",
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.date_format(values.coerce_value(stamp, T.DateType()), "yyyy-MM-dd").alias("day"),
        values.coerce_value(F.col("o_custkey").cast("string"), T.LongType()).alias("number"),
        values.coerce_list(F.array("o_orderstatus", "o_orderpriority")).alias("items"),
        values.same_value(at, utc).alias("same"),
        values.same_value(missing, F.lit(None)).alias("same_null"),
    )


_SCHEME_HOST = "regexp_extract(url, '^[a-z]+://[^/?#]*', 0)"


@query("t21_listing_urls", f"""
SELECT page_id, {_SCHEME_HOST} || '/' AS base, regexp_extract(url, '^[^#]*', 0) AS listing,
  regexp_extract(url, '^[^#]*', 0) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
    || 'id=' || CAST(page_id AS VARCHAR) || '+x' AS dedupe FROM pages""")
def _(t):
    url = F.col("url")
    token = F.concat(F.col("page_id").cast("string"), F.lit(" x"))
    return t.pages.select(
        "page_id",
        urls.site_base(url).alias("base"),
        urls.listing_url(url).alias("listing"),
        urls.dedupe_url(url, token).alias("dedupe"),
    )


@query("t22_code_order", """
SELECT id, CAST(CASE WHEN state = 'NATION_1' THEN 1 ELSE 0 END AS INT) AS k1,
  CASE WHEN state = 'NATION_1' THEN NULL ELSE id END AS k2,
  CASE WHEN state = 'NATION_1' THEN 'LAW-' || official_code ELSE official_code END AS k3 FROM inst""")
def _(t):
    code = F.when(F.col("state") == "NATION_1", F.concat(F.lit("LAW-"), "official_code")).otherwise(F.col("official_code"))
    k1, k2, k3 = values.code_order(code)
    return t.inst.select("id", k1.alias("k1"), k2.cast("long").alias("k2"), k3.alias("k3"))


RAW_PRIORITY = (
    "CASE p_type WHEN 'STANDARD' THEN CAST(p_size AS STRING) WHEN 'MEDIUM' THEN '\"' || CAST(p_size AS STRING) || '\"' "
    "WHEN 'ECONOMY' THEN 'true' WHEN 'PROMO' THEN 'null' WHEN 'SMALL' THEN '2.5' ELSE '\"high\"' END"
)


@query("t23_priority_rank",
       "SELECT p_partkey, CAST(CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN p_size ELSE 99 END AS INT) AS rank FROM part")
def _(t):
    return t.part.select("p_partkey", values.priority_rank(F.expr(RAW_PRIORITY)).alias("rank"))


@query("t24_md_cell", "SELECT doc_id, sha256(replace(replace(text, '|', '\\|'), chr(10), ' ')) AS cell FROM documents")
def _(t):
    return hashed(t, "cell", text.md_cell(F.col("text")))
