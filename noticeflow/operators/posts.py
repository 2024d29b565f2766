"""Post-API items and their merge with page items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticeflow.functions import text, urls
from noticeflow.functions.staging import stage
from noticeflow.lexicon import PORTUGUESE, Lexicon
from noticeflow.operators.links import first_per_key
from noticeflow.session import materialize

POST_TYPE = (
    "array<struct<link:string,title:struct<rendered:string>,"
    "excerpt:struct<rendered:string>,date:string>>"
)


def read_posts(responses: DataFrame) -> DataFrame:
    """Explode API payloads: source_id, url, term_order, pos, link, title, excerpt, date.

    Input: source_id, url, term_order, status_code, payload.  Failed responses and
    payloads that are not a list yield nothing.
    """
    ok = responses.filter(
        F.col("status_code").between(200, 399) & F.col("payload").rlike(r"^\s*\[")
    )
    parsed = ok.withColumn("posts", F.from_json("payload", POST_TYPE))
    flat = parsed.select("source_id", "url", "term_order", F.posexplode("posts").alias("pos", "post"))
    return flat.select(
        "source_id",
        "url",
        "term_order",
        "pos",
        F.col("post.link").alias("link"),
        F.col("post.title.rendered").alias("title"),
        F.col("post.excerpt.rendered").alias("excerpt"),
        F.col("post.date").alias("date"),
    )


def extract_posts(posts: DataFrame, lexicon: Lexicon = PORTUGUESE) -> DataFrame:
    """Relevant posts, once per absolute link in search order."""
    linked = posts.filter((F.coalesce("link", F.lit("")) != "") & F.col("title").isNotNull())
    cleaned = stage(
        linked, title=text.clean_text(F.col("title")), excerpt=text.clean_text(F.col("excerpt"))
    ).filter("title <> ''")
    staged = stage(cleaned, _f=text.fold_text(F.concat_ws(" ", "title", "link", "excerpt")))
    folded = F.col("_f")
    relevant = text.contains_any(folded, lexicon.strong_keywords) | (
        text.contains_any(folded, lexicon.broad_keywords)
        & text.contains_any(folded, lexicon.confirmations)
    )
    kept = stage(
        staged.filter(relevant),
        abs_url=urls.resolve_url(urls.site_base(F.col("url")), F.col("link")),
    )
    # Whole texts end here; what is shuffled for the first of a link is short.
    items = kept.select(
        "source_id",
        "term_order",
        "pos",
        "title",
        F.col("abs_url").alias("url"),
        text.infer_notice_type_folded(folded, lexicon).alias("notice_type"),
        text.truncate(F.col("excerpt"), 600).alias("description"),
    )
    return first_per_key(items, ["source_id", "url"], ["term_order", "pos"])


def merge_channels(api: DataFrame, page: DataFrame, page_failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, failed sources): API items first, then page items with an unseen URL.

    A failed page read is fatal only for sources the API gave nothing for.
    """
    columns = ["source_id", "title", "url", "notice_type", "description"]
    # Both results read it: extracted once, written.
    api = materialize(api.select(*columns, "term_order", "pos"), "api-items")
    both = api.select(*columns, F.lit(0).alias("channel"), "term_order", "pos").unionByName(
        page.select(*columns, F.lit(1).alias("channel"), F.lit(0).alias("term_order"), "pos")
    )
    usable = both.filter(F.coalesce("url", F.lit("")) != "")
    items = first_per_key(usable, ["source_id", "url"], ["channel", "term_order", "pos"])
    failed = page_failures.join(api.select("source_id").distinct(), "source_id", "left_anti")
    return items, failed
