"""Generic page extraction: link facts to notice items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticeflow.functions import text, urls
from noticeflow.functions.staging import stage
from noticeflow.lexicon import PORTUGUESE, Lexicon
from noticeflow.operators.html import extract_links

__all__ = [
    "extract_links", "admit_links", "gate_links", "choose_title", "drop_listing_titles",
    "first_per_key", "dedup_page", "extract_generic", "next_pages", "page_frontier",
    "union_frontier",
]

LONGEST_CONTEXT_FOR_GENERIC_LINK = 420


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of every key.

    ``row_number() = 1`` plans a partial group limit before the shuffle, so a hot key
    reaches its reducer as one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def admit_links(links: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Keep links that lead to a web page outside the ignored hosts."""
    href = F.col("href")
    scheme = F.lower(F.regexp_extract(href, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract("abs_url", r"^[A-Za-z]+://([^/?#]*)", 1))
    return links.filter(
        (href != "")
        & ~href.startswith("#")
        & ~scheme.isin(*lexicon.ignored_schemes)
        & urls.is_http(F.col("abs_url"))
        & ~host.isin(*lexicon.ignored_hosts)
    )


def is_generic_link(folded: Column, lexicon: Lexicon) -> Column:
    return folded.isin(*lexicon.generic_link_texts) | folded.rlike(r"^[0-9]+$")


def gate_links(links: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Keep links whose own words, or whose short context, name a notice."""
    path = F.regexp_extract("abs_url", r"(?s)^[^:/?#]+://[^/?#]*([^?#;]*)", 1)
    query = F.regexp_extract("abs_url", r"(?s)^[^?#]*\?([^#]*)", 1)
    own = F.array(F.col("text"), F.col("href"), urls.unquote(F.concat_ws(" ", path, query)))
    searched = stage(links, search_text=F.array_join(F.filter(own, lambda s: s != ""), " "))
    staged = stage(
        searched,
        text_key=text.fold_text(F.col("text")),
        _own=text.fold_text(F.col("search_text")),
        _ctx=text.fold_text(F.col("context")),
    )
    by_own = text.has_keyword_folded(F.col("_own"), lexicon)
    silent = (F.col("text") == "") | is_generic_link(F.col("text_key"), lexicon)
    by_context = (
        silent
        & (F.length("context") <= LONGEST_CONTEXT_FOR_GENERIC_LINK)
        & text.has_keyword_folded(F.col("_ctx"), lexicon)
    )
    return staged.filter(by_own | by_context).drop("_own", "_ctx")


def choose_title(links: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Title from the link text, else the context, else the last path segment."""
    last = F.regexp_extract("abs_url", r"(?s)^[^:/?#]+://[^/?#]*(?:[^?#;]*/)?([^/?#;]*)", 1)
    from_path = F.regexp_replace(
        F.regexp_replace(urls.unquote(last), "[-_]+", " "), r"\.[A-Za-z0-9]{2,5}$", ""
    )
    speaking = (F.col("text") != "") & ~is_generic_link(F.col("text_key"), lexicon)
    title = (
        F.when(speaking, text.truncate(F.col("text"), 240))
        .when(F.col("context") != "", text.truncate(F.col("context"), 240))
        .otherwise(text.truncate(text.squash(from_path), 240))
    )
    return stage(links, title=title).filter(F.col("title").isNotNull())


def bare_title(title: Column) -> Column:
    """Folded title without leading and trailing punctuation."""
    return F.regexp_replace(text.fold_text(title), r"(?U)^[\W_]+|[\W_]+$", "")


def drop_listing_titles(links: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Drop titles that only name a listing page, unless the target is a document."""
    staged = stage(links, _bare=bare_title(F.col("title")))
    listing = F.col("_bare").isin(*lexicon.listing_titles)
    document = urls.is_document_url(F.col("abs_url"), lexicon.document_suffixes)
    return staged.filter(~listing | document).drop("_bare")


def dedup_page(links: DataFrame) -> DataFrame:
    """First link per page and folded target."""
    keyed = stage(links, _key=text.fold_text(F.col("abs_url")))
    return first_per_key(keyed, ["page_id", "_key"], ["pos"]).drop("_key")


def notice_links(links: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    titled = choose_title(gate_links(admit_links(links, lexicon), lexicon), lexicon)
    return dedup_page(drop_listing_titles(titled, lexicon))


def extract_generic(pages: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Items of a page: page_id, pos, title, url, notice_type, description."""
    return link_items(extract_links(pages), lexicon)


def link_items(facts: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Items of pages whose links are extracted already."""
    kept = notice_links(facts, lexicon)
    folded = stage(kept, _f=text.fold_text(F.concat_ws(" ", F.col("search_text"), F.col("context"))))
    described = (F.col("context") != "") & (F.col("context") != F.col("title"))
    return folded.select(
        "page_id",
        "pos",
        "title",
        F.col("abs_url").alias("url"),
        text.infer_notice_type_folded(F.col("_f"), lexicon).alias("notice_type"),
        F.when(described, text.truncate(F.col("context"), 600)).alias("description"),
    )


def next_pages(links: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Distinct "next page" targets of every page: page_id, url, next_url, pos."""
    marks = F.concat_ws(
        " ",
        F.lower("rel"),
        F.lower("cls"),
        text.fold_text(F.col("text")),
        text.fold_text(F.col("title_attr")),
    )
    marked = stage(links, _marks=marks).filter(
        text.contains_any(F.col("_marks"), lexicon.next_markers) & urls.is_http(F.col("abs_url"))
    )
    return marked.groupBy("page_id", "url", F.col("abs_url").alias("next_url")).agg(F.min("pos").alias("pos"))


def page_frontier(next_links: DataFrame, max_extra: int = 2) -> DataFrame:
    """First ``max_extra`` next pages per seed; only then a link to the seed is dropped."""
    w = Window.partitionBy("page_id").orderBy("pos")
    ranked = next_links.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_extra)
    return ranked.filter(F.col("next_url") != F.col("url")).select("page_id", "url", "next_url", "rank")


def union_frontier(frontier: DataFrame, seeds: DataFrame, fetched: DataFrame, items) -> DataFrame:
    """Items of the seed page, then of its next pages; first occurrence of a URL wins.

    ``fetched`` holds every page of the crawl, seeds included; ``items(pages)`` extracts
    items; next pages that were not fetched are skipped.  Each page is parsed where it lies,
    and only its items, not its source, meet the visit list.
    """
    first = seeds.select(F.col("page_id").alias("seed_id"), "page_id", F.lit(0).alias("rank"))
    extra = frontier.select(
        F.col("page_id").alias("seed_id"), F.col("next_url").alias("url"), "rank"
    ).join(fetched.select("page_id", "url"), "url")
    visits = first.unionByName(extra.select("seed_id", "page_id", "rank"))
    reached = visits.join(items(fetched), "page_id")
    return first_per_key(reached, ["seed_id", "url"], ["rank", "pos"])
