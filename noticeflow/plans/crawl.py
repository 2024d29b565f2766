"""The crawl job: fetched pages to new notices, run log and source state."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from noticeflow.lexicon import PORTUGUESE, Lexicon
from noticeflow.operators import html, ingest, links, listings, posts, routing
from noticeflow.session import materialize


class CrawlResult(NamedTuple):
    notices: DataFrame
    runs: DataFrame
    sources: DataFrame


class Extracted(NamedTuple):
    items: DataFrame
    rescued: DataFrame  # sources whose API gave items: a failed page read does not fail them


# Places of items of several pages or channels, in reading order.
_PAGE, _CHANNEL = 1 << 20, 1 << 30


def extract_items(
    pages: DataFrame, sources: DataFrame, lexicon: Lexicon = PORTUGUESE,
    responses: DataFrame | None = None, more_pages: DataFrame | None = None,
) -> Extracted:
    """Items of every source by its extractor.

    ``pages``: page_id (the source id), url, html; ``more_pages``: next pages that were fetched,
    with ids of their own; ``responses``: API answers (source_id, url, term_order, status_code,
    payload). Every page is parsed for links once; sources meet flat items only, never page text,
    except that process-selection pages are picked out for their tables.
    """
    routes = routing.route_sources(sources).select(F.col("id").alias("page_id"), "extractor")
    route = lambda name: routes.filter(F.col("extractor") == name).select("page_id")
    fetched = pages if more_pages is None else pages.unionByName(more_pages)
    facts = materialize(html.extract_links(fetched), "links")
    found = materialize(links.link_items(facts, lexicon), "link-items")

    of = lambda name: found.join(route(name), "page_id", "left_semi")
    grouped = pages.join(route("sigaa"), "page_id", "left_semi")
    listed = listings.extract_process_pages(grouped, html.extract_signals(grouped, ()), lexicon)

    seeds = pages.join(route("pagination"), "page_id", "left_semi").select("page_id", "url")
    marked = facts.join(route("pagination"), "page_id", "left_semi")
    frontier = links.page_frontier(links.next_pages(marked, lexicon))
    paged = links.union_frontier(frontier, seeds, fetched.select("page_id", "url"), lambda _: found)
    paged = paged.withColumns({"pos": F.col("rank") * _PAGE + F.col("pos"), "page_id": F.col("seed_id")}).drop("rank", "seed_id")

    plain = of("generic").unionByName(paged).unionByName(listed, allowMissingColumns=True)
    own = of("wordpress").withColumnRenamed("page_id", "source_id")
    none = own.select("source_id").limit(0)
    if responses is None:
        merged, rescued = own, none
    else:
        asked = responses.join(route("wordpress").withColumnRenamed("page_id", "source_id"), "source_id", "left_semi")
        api = materialize(posts.extract_posts(posts.read_posts(asked), lexicon), "posts")
        merged, _ = posts.merge_channels(api, own, none)
        place = F.col("channel") * F.lit(_CHANNEL * _PAGE) + F.col("term_order") * _PAGE + F.col("pos")
        merged = merged.withColumn("pos", place).drop("channel", "term_order")
        rescued = api.select("source_id").distinct()
    items = plain.withColumnRenamed("page_id", "source_id").unionByName(merged, allowMissingColumns=True)
    return Extracted(items, rescued)


def run_crawl(
    pages: DataFrame, page_status: DataFrame, sources: DataFrame, institutions: DataFrame, history: DataFrame,
    now: Column, lexicon: Lexicon = PORTUGUESE, ids=None,
    responses: DataFrame | None = None, more_pages: DataFrame | None = None,
) -> CrawlResult:
    """One crawl over the active sources; a failed source adds nothing and stops nobody.

    Items are written once, because counting, duplicate removal and logging all read them.
    """
    targets = ingest.crawl_targets(sources, institutions, ids)
    wanted = pages.join(targets.select(F.col("id").alias("page_id")), "page_id", "left_semi")
    extracted = extract_items(wanted, targets, lexicon, responses, more_pages)
    items = materialize(extracted.items, "items")
    rescued = extracted.rescued.withColumn("_rescued", F.lit(True))
    status = page_status.join(rescued, "source_id", "left").select(
        "source_id", F.when(F.col("_rescued").isNull(), F.col("error_message")).alias("error_message")
    )
    normalized = ingest.normalize_items(ingest.drop_failed(items, status), targets)
    fresh = materialize(ingest.new_notices(normalized, history), "fresh")
    runs = ingest.run_log(targets, status, items, fresh, now)
    return CrawlResult(ingest.append_notices(fresh, now), runs, ingest.update_source_state(sources, runs))
