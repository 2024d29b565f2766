"""Process-selection listings: grouped tables, their fallback and page classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeflow.functions import text, urls
from noticeflow.functions.staging import stage
from noticeflow.lexicon import PORTUGUESE, Lexicon
from noticeflow.operators.html import extract_rows
from noticeflow.operators.links import bare_title, first_per_key, is_generic_link
from noticeflow.session import materialize

# Page-class markers on folded page text.
LOGIN_MARK = "acesso ao sistema"
LOGIN_FORMS = ("entrar com gov.br", "formusuario")
EMPTY_MARK = "nenhum processo seletivo encontra-se aberto"

_DATE = r"[0-9]{2}/[0-9]{2}/[0-9]{4}"
_PROCESS_ID = r"""['"]id['"]\s*:\s*['"]([^'"]+)['"]"""


def listing_groups(rows: DataFrame) -> DataFrame:
    """Group rows of listing tables with the first non-empty data row below each.

    Rows carry the running group number of their page; one aggregate with map-side
    combine finds the group row and the first non-empty row of its group.
    """
    listing = rows.filter("in_listing")
    filled = F.exists("cells", lambda c: c["text"] != "")
    detail = F.min_by("cells", F.when(~F.col("is_group") & filled, F.col("pos")))
    first = F.when(F.col("is_group"), F.struct("pos", "has_link", "link_text", "link_title", "link_onclick"))
    grouped = (
        listing.filter("grp > 0")
        .groupBy("page_id", "url", "grp")
        .agg(F.min(first).alias("g"), detail.alias("detail"))
    )
    return grouped.filter("g.has_link").select("page_id", "url", "g.*", "detail")


def _item_title() -> Column:
    raw = F.when(F.col("link_text") != "", F.col("link_text")).otherwise(F.col("link_title"))
    return F.trim(F.regexp_replace(raw, r"\s*\*+$", ""))


def listed_pages(groups: DataFrame) -> DataFrame:
    """page_id of every page with an item: a group with a title is one, whatever its details are."""
    return groups.filter(_item_title() != "").select("page_id").distinct()


def listing_details(groups: DataFrame) -> DataFrame:
    """Course, vacancies, period and situation of the detail row; the description."""
    texts = F.transform("detail", lambda c: c["text"])
    meaningful = F.filter(texts, lambda t: (t != "") & (t != "*"))
    dated = F.get(F.filter("detail", lambda c: c["text"].rlike(_DATE)), F.lit(0))
    second = F.get("_m", F.lit(1))
    closed = F.array_contains(F.split("_d.cls", r"\s+"), "fechado")
    out = (
        stage(groups, _m=meaningful, _d=dated, title=_item_title())
        .filter("title <> ''")
        .withColumn("course", F.get("_m", F.lit(0)))
        .withColumn("vacancies", F.when(second.rlike("^[0-9]+$"), second))
        .withColumn("period", F.col("_d.text"))
        .withColumn("situation", F.when(F.col("_d").isNotNull(), F.when(closed, "Fechado").otherwise("Aberto")))
    )
    # Wording of the description.
    described = F.concat_ws(
        "; ",
        F.concat(F.lit("Curso: "), F.col("course")),
        F.concat(F.lit("Vagas: "), F.col("vacancies")),
        F.concat(F.lit("Periodo de inscricoes: "), F.col("period")),
        F.concat(F.lit("Situacao: "), F.col("situation")),
    )
    return out.withColumn("description", F.coalesce(F.nullif(described, F.lit("")), F.col("title"))).drop("_m", "_d")


def listing_items(details: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Items with a stable duplicate key per process; first of equal keys wins."""
    process = F.nullif(F.trim(F.regexp_extract("link_onclick", _PROCESS_ID, 1)), F.lit(""))
    facts = F.concat_ws(
        "|",
        *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "course", "period", "vacancies")],
    )
    key = F.replace(text.fold_text(facts), F.lit(" "), F.lit("-"))
    # a longer key keeps its beginning; the digest of the whole tells processes apart
    digest = F.substring(F.sha2("_key", 256), 1, 16)
    fallback = F.when(F.length("_key") <= 160, F.col("_key")).otherwise(F.concat(F.substring("_key", 1, 160), F.lit("-"), digest))
    staged = stage(
        stage(details, _key=key, _listing=urls.listing_url(F.col("url"))),
        dedupe_url=urls.tagged_listing(F.col("_listing"), F.coalesce(process, fallback)),
        _f=text.fold_text(F.concat_ws(" ", "title", "description")),
    )
    unique = first_per_key(staged, ["page_id", "dedupe_url"], ["pos"])
    return unique.select(
        "page_id",
        "pos",
        "title",
        F.col("_listing").alias("url"),
        "dedupe_url",
        text.infer_notice_type_folded(F.col("_f"), lexicon).alias("notice_type"),
        text.truncate(F.col("description"), 600).alias("description"),
    )


def table_items(rows: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Fallback: one item per table row that names a notice and has a usable link."""
    named = stage(rows, _f=text.fold_text(F.col("row_text"))).filter(
        text.has_keyword_folded(F.col("_f"), lexicon)
    )
    usable = F.filter("links", lambda a: (a["href"] != "") & (a["href"] != "#"))
    texts = text.fold_texts(F.transform("_usable", lambda a: F.coalesce(a["text"], F.lit(""))))
    keyed = F.zip_with("_usable", "_keys", lambda a, key: a.withField("key", key))
    silent = F.filter("_links", lambda a: (a["key"] == "") | is_generic_link(a["key"], lexicon))
    best = F.coalesce(F.get(silent, F.lit(0)), F.get("_links", F.lit(0)))
    folded = stage(stage(named, _usable=usable), _keys=texts)
    linked = stage(stage(folded, _links=keyed).drop("_usable", "_keys"), _best=best).filter("_best is not null")

    href, abs_url, key = F.col("_best.href"), F.col("_best.abs_url"), F.col("_best.key")
    scheme = F.lower(F.regexp_extract(href, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(abs_url, r"^[A-Za-z]+://([^/?#]*)", 1))
    speaking = (F.col("_best.text") != "") & ~is_generic_link(key, lexicon)
    title = F.when(speaking, F.col("_best.text")).otherwise(F.col("row_text"))
    titled = stage(
        linked.filter(
            ~href.startswith("#")
            & ~scheme.isin(*lexicon.ignored_schemes)
            & urls.is_http(abs_url)
            & ~host.isin(*lexicon.ignored_hosts)
        ),
        full_title=title,
        abs_url=abs_url,
        _bare=bare_title(title),
    )
    kept = titled.filter(
        (F.col("full_title") != "")
        & (
            ~F.col("_bare").isin(*lexicon.listing_titles)
            | urls.is_document_url(F.col("abs_url"), lexicon.document_suffixes)
        )
    )
    unique = first_per_key(kept, ["page_id", "abs_url"], ["pos"])
    return unique.select(
        "page_id",
        "pos",
        text.truncate(F.col("full_title"), 240).alias("title"),
        F.col("abs_url").alias("url"),
        F.col("abs_url").alias("dedupe_url"),
        text.infer_notice_type_folded(F.col("_f"), lexicon).alias("notice_type"),
        text.truncate(
            F.when(F.col("row_text") != F.col("full_title"), F.col("row_text")), 600
        ).alias("description"),
    )


def classify_pages(signals: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, page_class: login, listing, empty or fallback, in that order."""
    folded = stage(signals, _f=text.fold_text(F.col("body_text")))
    login = F.col("_f").contains(LOGIN_MARK) & text.contains_any(F.col("_f"), LOGIN_FORMS)
    # Flags first: the join below moves no page text.
    flags = folded.select("page_id", login.alias("_login"), F.col("_f").contains(EMPTY_MARK).alias("_empty"))
    with_items = listed.select("page_id").distinct().withColumn("_items", F.lit(True))
    joined = flags.join(with_items, "page_id", "left")
    return joined.select(
        "page_id",
        F.when(F.col("_login"), "login")
        .when(F.col("_items"), "listing")
        .when(F.col("_empty"), "empty")
        .otherwise("fallback")
        .alias("page_class"),
    )


def extract_listing(rows: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    return listing_items(listing_details(listing_groups(rows)), lexicon)


def extract_process_pages(pages: DataFrame, signals: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Items of process-selection pages: listing items, or the table fallback.

    Three branches read the row facts, so they are parsed once and written.
    """
    rows = materialize(extract_rows(pages), "rows")
    listed = extract_listing(rows, lexicon)
    classes = classify_pages(signals, listed)
    by_class = lambda items, name: items.join(
        classes.filter(F.col("page_class") == name).select("page_id"), "page_id", "left_semi"
    )
    return by_class(listed, "listing").unionByName(by_class(table_items(rows, lexicon), "fallback"))
