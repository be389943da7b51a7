"""Crawling a link graph level by level from a table of pages.

``pages(url, html)`` stands for the network (``fetch_site`` fills it); every page is
parsed once.  Levels are equi-joins of the frontier with the link table, an anti-join
with what was seen, and a distinct; each level is stored, with a reliable checkpoint
where a checkpoint folder is set.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.urls import extract_domain_name, host, matches_patterns, normalize_url, url_to_filename


def allowed(url: str, start_host: str, include: list[str] | None = None, exclude: list[str] | None = None):
    """Column: may this URL be fetched?"""
    u = F.col(url)
    ok = host(u) == start_host
    if include is not None:
        ok = ok & matches_patterns(u, include)
    return ok & ~matches_patterns(u, exclude) if exclude else ok


def crawl_levels(seeds: DataFrame, links: DataFrame, max_depth: int = 3, checkpoint: bool = True) -> DataFrame:
    """(url, depth): breadth-first from ``seeds(url)`` over ``links(src, dst)``, each URL at its first depth.

    ``max_depth`` 0 is the seeds alone.
    """
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    keep = _kept if checkpoint else lambda df: df
    seen = frontier = keep(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        next_ = frontier.join(links, frontier.url == links.src).select(F.col("dst").alias("url")).distinct()
        frontier = keep(next_.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def crawl_depth_first(seeds: DataFrame, links: DataFrame, max_depth: int = 3) -> DataFrame:
    """(site, url, depth, visit): the order of a sequential recursive crawl.

    ``seeds(site, url)``, ``links(site, src, dst, pos)``.  A link is marked as found when its
    turn comes, not when its page is read, so a page first met deep stays deep.  The order is
    sequential by nature: one task holds the links of one site.
    """

    def walk(key, start: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        out_of = {s: list(dict.fromkeys(g.sort_values("pos")["dst"])) for s, g in edges.groupby("src")}
        visited, found, order = set(), set(), []
        for seed in start["url"]:
            path = [iter([seed])]  # one iterator of links for each page being read
            while path:
                url = next(path[-1], None)
                if url is None:
                    path.pop()
                    continue
                depth = len(path) - 1
                if depth and url in found:
                    continue
                found.update([url] if depth else [])
                if url in visited:
                    continue
                visited.add(url)
                order.append((key[0], url, depth, len(order)))
                if depth < max_depth:
                    path.append(iter(out_of.get(url, [])))
        return pd.DataFrame(order, columns=["site", "url", "depth", "visit"])

    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    return seeds.groupBy("site").cogroup(links.groupBy("site")).applyInPandas(walk, "site string, url string, depth int, visit int")


def _kept(df: DataFrame) -> DataFrame:
    """Stored once: in the checkpoint folder where there is one, else in the executors' memory and disks."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def crawl_pages(pages: DataFrame, start: str, max_depth: int = 3, include: list[str] | None = None, exclude: list[str] | None = None, order: str = "breadth") -> DataFrame:
    """(url, depth, visit, title, markdown, links, error, name, file): the pages of one site reached from ``start``.

    Pages of other hosts are left out first, each page left is parsed once; of pages with one
    normalised URL the first in order of URL and HTML counts.  ``order`` is "breadth" or "depth";
    ``visit`` is null for the first.
    """
    from docquarry.operators.html import parse_pages

    if order not in ("breadth", "depth"):
        raise ValueError("order must be breadth or depth")
    spark = pages.sparkSession
    seed = spark.createDataFrame([(start,)], "raw string").select(normalize_url(F.col("raw")).alias("url"), F.coalesce(host(F.col("raw")), F.lit("")).alias("host"))
    start_host = seed.first().host
    own = pages.select("url", "html").filter(host(F.col("url")) == start_host).withColumn("key", normalize_url(F.col("url")))
    one = own.groupBy("key").agg(F.min(F.struct("url", "html")).alias("page"))
    parsed = _kept(parse_pages(one.select("key", "page.*"), keep=["key"]).drop("url"))
    fetched = parsed.filter("error IS NULL")  # a page that fails is not expanded
    edges = fetched.select(F.col("key").alias("src"), F.posexplode("links").alias("pos", "link")).select("src", "pos", normalize_url(F.col("link")).alias("dst"))
    edges = edges.filter(allowed("dst", start_host, include, exclude)).groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    seeds = seed.filter(allowed("url", start_host, include, exclude)).select("url")
    if order == "breadth":
        reached = crawl_levels(seeds, edges, max_depth).withColumn("visit", F.lit(None).cast("int"))
    else:
        # Only pages that exist count as visited; links to others are marked and lead nowhere.
        edges = edges.join(parsed.select(F.col("key").alias("dst")), "dst", "left_semi")
        reached = crawl_depth_first(seeds.withColumn("site", F.lit(start_host)), edges.withColumn("site", F.lit(start_host)), max_depth).drop("site")
    return reached.join(parsed.withColumnRenamed("key", "url"), "url").withColumns({"name": extract_domain_name(F.lit(start)), "file": url_to_filename(F.col("url"))})


def fetch_site(spark, start: str, fetch, max_depth: int = 3, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(url, html) of one site, fetched level by level with ``fetch(frontier)`` (url, html, error); every URL is asked once."""
    from docquarry.operators.html import parse_pages

    seed = spark.createDataFrame([(start,)], "raw string").select(normalize_url(F.col("raw")).alias("url"), F.coalesce(host(F.col("raw")), F.lit("")).alias("host"))
    start_host = seed.first().host
    frontier, seen, got = seed.filter(allowed("url", start_host, include, exclude)).select("url"), None, None
    for depth in range(max_depth + 1):
        level = _kept(fetch(frontier).select("url", "html"))
        seen = level.select("url") if seen is None else seen.unionByName(level.select("url"))
        got = level if got is None else got.unionByName(level)
        if depth == max_depth:
            break
        links = parse_pages(level.filter("html IS NOT NULL")).filter("error IS NULL").select(F.explode("links").alias("link"))
        next_ = links.select(normalize_url(F.col("link")).alias("url")).filter(allowed("url", start_host, include, exclude)).distinct()
        frontier = _kept(next_.join(seen, "url", "left_anti"))
        if frontier.isEmpty():
            break
    return got


def crawl_stats(crawled: DataFrame, links: DataFrame) -> DataFrame:
    """One row: discovered, processed, saved, errors."""
    found = links.join(crawled.select(F.col("url").alias("src")), "src", "left_semi").select("dst").distinct()
    events = found.select(F.lit("discovered").alias("what")).unionByName(crawled.select(F.when(F.col("error").isNull(), "saved").otherwise("error").alias("what")))
    count = lambda *kinds: F.count_if(F.col("what").isin(*kinds))
    return events.agg(count("discovered").alias("discovered"), count("saved", "error").alias("processed"), count("saved").alias("saved"), count("error").alias("errors"))


def last_write_wins(files: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows that write one path: the last one stays."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return files.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")
