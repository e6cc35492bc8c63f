"""Links of pages, followed breadth first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import absolute_url, links, url_stem
from ..shared import checkpointed


#: Start pages whose stems bound a crawl.
MOST_STEMS = 1_000


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, link): the distinct links of each page, resolved against its URL."""
    each = pages.select(F.col(url_col).alias("url"), F.explode(links(F.col(html_col))).alias("_l"))
    return each.select("url", absolute_url(F.col("_l"), F.col("url")).alias("link")).distinct()


def find_links(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], depth: int = 0, children_only: bool | str = False, url_filter: Callable[[Column], Column] | None = None, checkpoint: Callable[[DataFrame], DataFrame] = checkpointed, validate: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(links(url), problems(link, problem)) reached from start(url) over pages up to `depth` steps away.

    fetch turns urls(url) into pages(url, html[, resolved]); a URL without a page is a problem, and one that was redirected
    counts under the address in `resolved`, which its links are resolved against too. children_only keeps links below
    the stem of a start page, or those that begin with a given prefix; it and url_filter hold for redirected addresses too. Links
    whose page was asked for and not found are problems and no links. validate turns urls(url) into the ones(url) that
    answer; the others are problems and no links. Each level is one join of the frontier with the pages and one anti-join with what was
    visited; its result is checkpointed in the shared folder, so the plan grows by one scan of addresses a level.
    """
    stems = [children_only] if isinstance(children_only, str) else None
    if children_only is True:
        stems = [r[0] for r in start.select(url_stem(F.col("url"))).where("url is not null").distinct().limit(MOST_STEMS + 1).collect()]
        if len(stems) > MOST_STEMS:
            raise ValueError(f"children_only takes up to {MOST_STEMS} start pages")

    def fit(urls: DataFrame) -> DataFrame:
        if stems is not None:
            urls = urls.where(F.exists(F.array(*[F.lit(x) for x in stems]), lambda x: F.col("url").startswith(x)))
        return urls if url_filter is None else urls.where(url_filter(F.col("url")))

    frontier = visited = checkpoint(start.select("url").distinct())
    collected = problems = moved = None
    for level in range(depth + 1):
        pages = fetch(frontier)
        if "resolved" in pages.columns:
            to = pages.where("resolved is not null and resolved <> url").groupBy("url").agg(F.min("resolved").alias("to"))
            moved = to if moved is None else moved.union(to)
            pages = pages.withColumn("asked", F.col("url")).withColumn("url", F.coalesce("resolved", "url"))
        else:
            pages = pages.withColumn("asked", F.col("url"))
        missing = frontier.join(pages.select(F.col("asked").alias("url")).distinct(), "url", "left_anti").select(F.col("url").alias("link"), F.lit("not found").alias("problem"))
        missing = checkpoint(missing)
        found = checkpoint(fit(page_links(pages).select(F.col("link").alias("url")).distinct()))
        collected = found if collected is None else collected.union(found)
        problems = missing if problems is None else problems.union(missing)
        if level < depth:
            frontier = checkpoint(found.join(visited, "url", "left_anti"))
            visited = visited.union(frontier)  # each level was written once
            if frontier.isEmpty():
                break
    collected = collected.distinct().join(problems.select(F.col("link").alias("url")).distinct(), "url", "left_anti")
    if moved is not None:
        moved = checkpoint(moved.groupBy(F.col("url").alias("was")).agg(F.min("to").alias("to")))
        collected = fit(collected.join(moved, F.col("url") == F.col("was"), "left").select(F.coalesce("to", "url").alias("url")))
    collected = collected.distinct()
    if validate is not None:
        collected = checkpoint(collected)
        good = checkpoint(validate(collected).select("url").distinct())
        lost = collected.join(good, "url", "left_anti").select(F.col("url").alias("link"), F.lit("does not answer").alias("problem"))
        collected, problems = collected.join(good, "url", "left_semi"), problems.union(lost)
    return collected, problems.distinct()
