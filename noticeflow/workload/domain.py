"""Domain tables as projections of the benchmark star schema.

One SQL text per table serves Spark and the DuckDB comparison; the few functions the
two spell differently come from a dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from noticeflow.session import bounded_batches, spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class SparkDialect:
    @staticmethod
    def sha(x):
        return f"sha2({x}, 256)"

    @staticmethod
    def minutes(ts, n):
        return f"timestampadd(MINUTE, CAST({n} AS INT), {ts})"

    ts = staticmethod(lambda x: f"CAST({x} AS TIMESTAMP)")
    initcap = staticmethod(lambda x: x)


class DuckDialect:
    @staticmethod
    def sha(x):
        return f"sha256({x})"

    @staticmethod
    def minutes(ts, n):
        return f"({ts} + to_minutes(CAST({n} AS BIGINT)))"

    ts = staticmethod(lambda x: f"CAST({x} AS TIMESTAMP)")


NOW = "TIMESTAMP '2024-01-20 00:00:00'"

# Test vocabulary: frequent fragments of the synthetic text.
TEST_KEYWORDS = (
    "the", "que", "der", "tion", "ment", "los", "and", "ist", "ción", "eau", "Wh_n", "th%ing",
)


def esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def domain_sql(d) -> dict[str, str]:
    n_inst = "(SELECT count(*) FROM supplier)"
    keyword = " ".join(
        f"WHEN {i} THEN '{k}'" for i, k in enumerate(TEST_KEYWORDS)
    )
    return {
        "inst": f"""
            SELECT s_suppkey AS id, s_name AS name, s_name AS official_name,
              CAST(s_suppkey AS STRING) AS official_code,
              CASE WHEN s_nationkey = 3 THEN 'post_census_law' ELSE 'census' END AS official_code_origin,
              'I' || CAST(s_suppkey % 40 AS STRING) AS initials,
              n_name AS state, r_name AS region,
              CAST(1 + s_suppkey % 3 AS INT) AS administrative_category_code,
              'Category ' || CAST(1 + s_suppkey % 3 AS STRING) AS administrative_category,
              CAST(1 + s_suppkey % 5 AS INT) AS academic_organization_code,
              'Organization ' || CAST(1 + s_suppkey % 5 AS STRING) AS academic_organization,
              CASE WHEN s_acctbal < 500 THEN 'excluded_inactive'
                   WHEN s_acctbal > 9000 THEN 'included_manual_review' ELSE 'included' END AS eligibility_status,
              CASE s_suppkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'partial'
                   WHEN 2 THEN 'manual_review' ELSE 'source_not_found' END AS source_discovery_status,
              CASE WHEN s_acctbal > 5000 THEN 'note ' || s_name ELSE NULL END AS source_discovery_notes,
              'https://www.inst' || CAST(s_suppkey AS STRING) || '.edu.br' AS official_site_url,
              s_acctbal >= 0 AS is_active, s_acctbal AS balance
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        "src": f"""
            SELECT p_partkey AS id, p_partkey % {n_inst} AS institution_id,
              p_name || ' ' || p_brand AS name,
              'https://' || lower(replace(p_brand, '#', '')) || '.inst' || CAST(p_partkey % {n_inst} AS STRING)
                || CASE WHEN p_type = 'PROMO' THEN '.gov.br/' WHEN p_type = 'SMALL' THEN '.wordpress.example/'
                   ELSE '.edu.br/' END || replace(p_name, ' ', '-') || '/' || CAST(p_partkey AS STRING) AS url,
              CASE p_type WHEN 'STANDARD' THEN 'SIGAA' WHEN 'MEDIUM' THEN 'wordpress'
                   WHEN 'ECONOMY' THEN 'TABLE_HTML' WHEN 'LARGE' THEN 'HTML_STATIC' ELSE 'editais' END AS source_type,
              'src-' || CAST(p_partkey AS STRING) AS catalog_source_id,
              CASE WHEN p_size <= 10 THEN 'generic' WHEN p_size <= 20 THEN 'wordpress' WHEN p_size <= 30 THEN 'govbr'
                   WHEN p_size <= 40 THEN 'sigaa' ELSE 'pagination' END AS recommended_spider,
              CASE WHEN p_size <= 15 THEN 'verified' WHEN p_size <= 25 THEN 'partial'
                   WHEN p_size <= 32 THEN 'manual_review' WHEN p_size <= 38 THEN 'temporarily_unavailable'
                   WHEN p_size <= 44 THEN 'source_not_found' ELSE NULL END AS coverage_status,
              p_size AS priority_size, CAST(1 + p_size % 3 AS INT) AS priority,
              p_size % 2 = 0 AS is_active,
              CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(60 * p_size AS INT) END AS check_frequency_minutes,
              CASE WHEN p_retailprice > 1200 THEN NULL
                   ELSE {d.minutes("TIMESTAMP '2024-01-18 00:00:00'", "p_size * 40")} END AS last_checked_at,
              CASE WHEN p_retailprice > 1100 THEN NULL
                   ELSE {d.minutes("TIMESTAMP '2024-01-18 00:00:00'", "p_size * 40")} END AS last_success_at,
              CASE WHEN p_brand = 'Brand#13' THEN 'timeout' ELSE NULL END AS last_error_message,
              CASE WHEN p_type = 'LARGE' THEN {d.minutes("TIMESTAMP '2024-01-02 00:00:00'", "p_size")}
                   ELSE NULL END AS capture_validated_at
            FROM part""",
        "runs": f"""
            SELECT event_id AS id, user_id AS source_id,
              CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
              CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'signup' THEN NULL
                   ELSE CAST(floor(value) AS BIGINT) END AS items_found,
              CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'signup' THEN NULL
                   ELSE CAST(floor(value / 3) AS BIGINT) END AS new_items,
              CASE WHEN event_type = 'error' THEN 'http 500' ELSE NULL END AS error_message,
              {d.ts("ts")} AS started_at, {d.minutes(d.ts("ts"), "2")} AS finished_at
            FROM events""",
        "ntc": f"""
            SELECT doc_id AS id, doc_id % {n_inst} AS institution_id,
              doc_id % (SELECT count(*) FROM part) AS source_id,
              split_part(text, chr(10), 1) AS title,
              lower(trim(split_part(text, chr(10), 1))) AS normalized_title,
              text AS description,
              'https://' || source || '.example/d/' || substr({d.sha("text")}, 1, 12) AS url,
              'https://' || source || '.example/d/' || substr({d.sha("text")}, 1, 12) AS normalized_url,
              CASE lang WHEN 'en' THEN 'edital' WHEN 'fr' THEN 'concurso' WHEN 'de' THEN 'bolsa'
                   ELSE 'resultado' END AS notice_type,
              {d.minutes("TIMESTAMP '2024-01-01 00:00:00'", "doc_id")} AS detected_at,
              {d.sha("CAST(doc_id % " + n_inst + " AS STRING) || '|' || lower(trim(split_part(text, chr(10), 1))) || '|' || 'https://' || source || '.example/d/' || substr(" + d.sha("text") + ", 1, 12)")} AS fingerprint,
              n_chars % 17 <> 0 AS is_active, lang, source
            FROM documents""",
        "usr": """
            SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.org' AS email
            FROM customer WHERE c_acctbal > 100""",
        "alr": f"""
            SELECT c_custkey AS id, c_custkey AS user_id,
              CASE c_custkey % {len(TEST_KEYWORDS)} {keyword} END AS keyword,
              CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % {n_inst} END AS institution_id,
              CASE WHEN c_custkey % 2 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'concurso'
                   WHEN c_mktsegment = 'MACHINERY' THEN 'bolsa' ELSE 'edital' END AS notice_type,
              c_acctbal > 0 AS is_active
            FROM customer""",
        # Pages built around documents: a titled article and a block with a bare link.
        "dpg": f"""
            SELECT -1 - doc_id AS page_id, 'https://' || source || '.example.edu.br/lista/' AS url,
              '<html><body><article><h2>' || {esc("split_part(text, chr(10), 1)")} || '</h2><p><a href="docs/'
                || CAST(doc_id AS STRING) || '.pdf">Acesse aqui</a></p></article><div>' || {esc("text")}
                || ' <a href="/n/' || CAST(doc_id AS STRING) || '">pdf</a></div></body></html>' AS html
            FROM documents""",
        "apg": "SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM dpg",
        # Process-selection pages, one per order: two groups, the second without details.
        "opg": """
            SELECT o_orderkey AS page_id,
              'https://sigaa.example.br/p/lista.jsf?c=' || CAST(o_custkey AS STRING) || '&id=9' AS url,
              '<html><body>' || CASE WHEN o_orderstatus = 'P' THEN 'Acesso ao  Sistema formUsuario'
                WHEN o_orderpriority = '5-LOW' THEN 'Nenhum processo seletivo encontra-se aberto' ELSE '' END
              || '<table' || CASE WHEN o_orderpriority IN ('5-LOW', '2-HIGH') THEN '' ELSE ' class="x listagem"' END
              || '><tr><td class="agrupador"><a href="/g/' || CAST(o_orderkey AS STRING)
              || '" onclick="f([''id'':''' || CAST(o_orderkey AS STRING) || '''])">Edital ' || o_orderpriority
              || ' *</a></td></tr><tr><td> </td></tr><tr><td>' || o_orderpriority || '</td><td>'
              || CAST(o_custkey AS STRING) || '</td><td class="periodo' || CASE WHEN o_orderstatus = 'F'
                THEN ' fechado' ELSE '' END || '">' || substr(CAST(o_orderdate AS STRING), 9, 2) || '/'
              || substr(CAST(o_orderdate AS STRING), 6, 2) || '/' || substr(CAST(o_orderdate AS STRING), 1, 4)
              || '</td></tr><tr><td class="agrupador"><a href="#">Bolsa ' || o_orderstatus
              || '</a></td></tr></table></body></html>' AS html,
              o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
              substr(CAST(o_orderdate AS STRING), 9, 2) || '/' || substr(CAST(o_orderdate AS STRING), 6, 2) || '/'
                || substr(CAST(o_orderdate AS STRING), 1, 4) AS period
            FROM orders""",
        # A chain of listing pages: each links to the next and to an item two pages share.
        "cpg": """
            SELECT doc_id AS page_id, 'https://chain.example/p/' || CAST(doc_id AS STRING) AS url,
              '<ul><li><a href="/i/' || CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING) || '">que item '
                || CAST(doc_id AS STRING) || '</a></li></ul><a class="next" href="' || CAST(doc_id + 1 AS STRING)
                || '">2</a><a rel="next" href="/p/' || CAST(doc_id AS STRING) || '">3</a>' AS html
            FROM documents""",
        # Fixed-container pages built around parts.
        "bpg": """
            SELECT p_partkey AS page_id, 'https://box.example/' AS url,
              '<div class="a notice-item"><p><a href="/b/' || CAST(p_partkey AS STRING) || '">' || p_name
                || '</a></p><span class="date">' || p_brand || '</span></div><div class="notice-item">x</div>' AS html
            FROM part""",
        # Crawled items: relative links below the source address.
        "itm": f"""
            SELECT doc_id % {n_inst} AS source_id, CAST(doc_id AS INT) AS pos,
              split_part(text, chr(10), 1) AS title, '/d/' || lang || '-' || CAST(n_chars % 4 AS STRING) || '?utm_x=1#f' AS url,
              CAST(NULL AS STRING) AS dedupe_url, lang AS notice_type, text AS description,
              CAST(NULL AS STRING) AS publication_date
            FROM documents""",
        # The same items in normal form, and the history they meet.
        "nrm": f"""
            SELECT i.source_id, pos, s.institution_id, trim(title) AS title, lower(trim(title)) AS normalized_title,
              'https://' || split_part(s.url, '/', 3) || split_part(i.url, '?', 1) AS url, notice_type,
              {d.sha("CAST(s.institution_id AS STRING) || '|' || lower(trim(title)) || '|https://' || split_part(s.url, '/', 3) || split_part(i.url, '?', 1)")} AS fingerprint
            FROM itm i JOIN src s ON i.source_id = s.id WHERE trim(title) <> ''""",
        "hst": """
            SELECT institution_id, url AS normalized_url, CASE WHEN notice_type = 'de' THEN 'other' ELSE fingerprint END AS fingerprint
            FROM nrm WHERE notice_type IN ('fr', 'de')
            UNION ALL SELECT institution_id, 'https://moved.example/', fingerprint FROM nrm WHERE notice_type = 'es'""",
        # The registry before a catalog merge: part of the institutions, some without a code.
        "reg": """
            SELECT id + 100000 AS id, CASE WHEN balance < 4000 THEN name || ' old' ELSE name END AS name, initials, state,
              CASE WHEN balance < 6000 THEN NULL ELSE official_code END AS official_code, region,
              administrative_category_code, administrative_category, academic_organization_code, academic_organization,
              CASE WHEN balance > 9500 THEN NULL ELSE eligibility_status END AS eligibility_status,
              CASE WHEN balance > 7000 THEN source_discovery_status ELSE 'partial' END AS source_discovery_status,
              source_discovery_notes,
              CASE WHEN balance > 8000 THEN NULL ELSE 'https://kept.example' END AS official_site_url,
              balance < 9000 AS is_active
            FROM inst WHERE balance >= 2000""",
        # The catalog to merge, and its sources with replacement rules.
        "cat": """
            SELECT official_code, official_name, CAST(NULL AS STRING) AS official_initials, initials, state, region,
              administrative_category_code, administrative_category, academic_organization_code, academic_organization,
              eligibility_status, source_discovery_status AS coverage_status, source_discovery_notes AS coverage_notes,
              official_site_url, CASE WHEN balance < 1000 THEN 'created_pending_implementation' ELSE 'manual_review' END AS current_situation,
              official_code_origin, id AS catalog_order, balance
            FROM inst""",
        "csr": """
            SELECT p_partkey, CAST(s.institution_id AS STRING) AS official_code, s.catalog_source_id, s.name, s.source_type,
              s.recommended_spider, s.coverage_status AS status, s.priority,
              CASE WHEN p_type = 'ECONOMY' THEN replace(s.url, 'https://', 'https://xn--so-sia.') ELSE s.url END AS url, p_type,
              CASE WHEN p_type = 'LARGE' AND s.priority = 1 THEN '2026-01-01' ELSE NULL END AS capture_at,
              '2026-07-' || lpad(CAST(1 + p_size % 28 AS STRING), 2, '0') || 'T00:00:00Z' AS verified_at,
              CASE p_type WHEN 'MEDIUM' THEN 'old-' || CAST(p_partkey AS STRING)
                WHEN 'PROMO' THEN 'https://ANTIGÃO.example/' || CAST(p_partkey AS STRING) || '/'
                WHEN 'SMALL' THEN 'Légacy  NAME ' || CAST(p_partkey AS STRING) ELSE NULL END AS replaced
            FROM src s JOIN part ON p_partkey = s.id""",
        "rsr": """
            SELECT p_partkey + 500000 AS id, s.institution_id + 100000 AS institution_id,
              CASE p_type WHEN 'STANDARD' THEN s.catalog_source_id WHEN 'MEDIUM' THEN 'old-' || CAST(p_partkey AS STRING)
                WHEN 'LARGE' THEN 'other-' || CAST(p_partkey AS STRING) ELSE NULL END AS catalog_source_id,
              CASE WHEN p_type = 'SMALL' THEN 'legacy name ' || CAST(p_partkey AS STRING) ELSE s.name END AS name,
              CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'STANDARD') THEN s.url
                ELSE 'https://xn--antigo-7ta.example/' || CAST(p_partkey AS STRING) END AS url,
              CASE WHEN p_type = 'ECONOMY' THEN replace(s.url, 'https://', 'https://São.') WHEN p_type = 'LARGE' THEN s.url WHEN p_type = 'STANDARD' THEN s.url ELSE NULL END AS normalized_url,
              s.source_type, s.recommended_spider,
              CASE WHEN p_size < 25 THEN s.coverage_status ELSE NULL END AS coverage_status, s.priority, s.is_active,
              s.check_frequency_minutes, s.last_checked_at, s.last_success_at, s.last_error_message,
              s.capture_validated_at, p_type
            FROM src s JOIN part ON p_partkey = s.id JOIN inst i ON i.id = s.institution_id
            WHERE p_retailprice < 1500 AND balance >= 2000""",
        "ntf": """
            SELECT event_id AS id, user_id, event_id % (SELECT count(*) FROM documents) AS notice_id,
              CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
              CASE WHEN event_type = 'purchase' THEN CAST(ts AS TIMESTAMP) ELSE NULL END AS sent_at,
              CASE WHEN event_type = 'error' THEN 'bounced' ELSE NULL END AS error_message
            FROM events""",
    }


def oracle_with(sql: str, *extra: tuple[str, str]) -> str:
    """DuckDB text with every domain table as a common table expression."""
    tables = list(domain_sql(DuckDialect).items()) + list(extra)
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in tables) + "\n" + sql


class Tables:
    """Lazy access to base and domain tables of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._sql = domain_sql(SparkDialect)
        bounded_batches(spark)

    def base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # Long texts, or addresses built from short rows, in one small file would keep a single core busy.
        return spread(df) if name in ("documents", "part") else df

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run a query text over base, domain and given frames."""
        for name in set(re.findall(r"\b(?:FROM|JOIN)\s+([A-Za-z_]+)", text)):
            if name in BASE_TABLES or name in self._sql:
                frames.setdefault(name, getattr(self, name))
        pattern = r"\b((?:FROM|JOIN)\s+)(" + "|".join(map(re.escape, frames)) + r")\b"
        bound = re.sub(pattern, r"\1{\2}", text) if frames else text
        return self.spark.sql(bound, **{k: v for k, v in frames.items() if "{" + k + "}" in bound})

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name in self.__dict__.get("_sql", {}):
            return self.sql(self._sql[name])
        raise AttributeError(name)
