"""Discovery: which stored documents and cheat sheets belong to a URL, and whether work should go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.urls import site_key

# Where a file may say its URL, in the order tried.
DOC_URLS = (r"<!-- Source: (https?://[^\s]+) -->", r"\[Source\]\((https?://[^\)]+)\)", r"Original: (https?://[^\s]+)", r"URL: (https?://[^\s]+)", r"(https?://[^\s]+)")
SHEET_URLS = (r"<!-- Generated from: (https?://[^\s]+) -->", r"Source: (https?://[^\s]+)", r"\*\*Source:\*\* (https?://[^\s]+)", r"Based on: (https?://[^\s]+)", r"(https?://[^\s\)]+)")
FUNCTION_MARKS = (r"`[^`]*\([^)]*\)`", r"\|\s*`[^`]+`\s*\|", r"`[^`]*<%[^%]*%>[^`]*`")


def _first(text: Column, patterns: tuple[str, ...]) -> list[Column]:
    return [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]


def url_of_document(content: Column, path: Column) -> Column:
    """The URL a document states, else its dotted file name as a host, else null."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.md\z", "")
    return F.coalesce(*_first(content, DOC_URLS), F.when(F.contains(name, F.lit(".")), F.concat(F.lit("https://"), name)))


def url_of_cheatsheet(content: Column) -> Column:
    return F.coalesce(*_first(content, SHEET_URLS))


def section_titles(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^##\s+(.+)$"), 1), lambda t: F.trim(t))


def count_functions(content: Column) -> Column:
    return sum((F.regexp_count(content, F.lit(p)) for p in FUNCTION_MARKS), F.lit(0))


def format_size(size: Column) -> Column:
    said = lambda x, unit: F.concat(F.round(x).cast("long").cast("string"), F.lit(unit))
    return F.when(size < 1024, said(size, "B")).when(size < 1024 * 1024, said(size / 1024, "KB")).otherwise(said(size / (1024 * 1024), "MB"))


def format_date(at: Column) -> Column:
    return F.date_format(at, "MMM d, yyyy")


def find_documentation(files: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Documents (path, content, bytes, modified) with their URL and category (apis where the path has such a folder, else tools);
    with ``targets(target)`` those of the same site.

    The site is an equi-join key, so no target is compared with every file.
    """
    found = files.filter(F.endswith("path", F.lit(".md")) & ~F.col("path").rlike(r"(^|/)(\.[^/]+|node_modules)/"))
    found = found.withColumn("url", F.coalesce(url_of_document(F.col("content"), F.col("path")), F.lit(""))).drop("content")
    found = found.withColumn("category", F.when(F.contains("path", F.lit("/apis/")), "apis").otherwise("tools"))
    return _of_targets(found, targets)


def find_cheatsheets(files: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Cheat sheets in folders of tools or apis, with URL, section titles and function count; with ``targets(target)`` those of the same site."""
    found = files.filter(F.col("path").rlike(r"(^|/)(tools|apis)/")).filter(F.col("path").rlike(r"Cheatsheet[^/]*\.md\z|[^/]*Cheatsheet[^/]*\.md\z") & ~F.col("path").rlike(r"(^|/)\.[^/]+/"))
    c = F.col("content")
    found = found.select("*", F.coalesce(url_of_cheatsheet(c), F.lit("")).alias("url"), section_titles(c).alias("sections"), count_functions(c).alias("function_count")).drop("content")
    return _of_targets(found, targets)


def _of_targets(found: DataFrame, targets: DataFrame | None) -> DataFrame:
    if targets is None:
        return found
    keyed = targets.select("target", site_key(F.col("target")).alias("_site")).filter("_site IS NOT NULL")
    return found.withColumn("_site", site_key(F.col("url"))).join(keyed, "_site").drop("_site")


def totals(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.sum("bytes").alias("bytes"))


def describe(found: DataFrame) -> DataFrame:
    """(path, entry): a finding's lines in the report."""
    sections = F.concat(F.array_join(F.slice("sections", 1, 3), ", "), F.when(F.size("sections") > 3, "...").otherwise(""))
    lines = [
        F.concat(F.lit("**"), F.substring_index("path", "/", -1), F.lit("**")), F.concat(F.lit("- Path: "), F.col("path")), F.concat(F.lit("- Size: "), format_size(F.col("bytes"))),
        F.concat(F.lit("- Modified: "), format_date(F.col("modified"))), F.when(F.col("url") != "", F.concat(F.lit("- Source: "), F.col("url"))),
    ]
    if "sections" in found.columns:
        lines += [F.when(F.size("sections") > 0, F.concat(F.lit("- Sections: "), sections)), F.when(F.col("function_count") > 0, F.concat(F.lit("- Functions: ~"), F.col("function_count").cast("string"), F.lit(" entries")))]
    return found.select("path", F.concat_ws("\n", *lines).alias("entry"))


def should_proceed(documents: DataFrame, sheets: DataFrame, force: bool = False, gate: str = "all") -> tuple[bool, str]:
    """(go on?, message): stop where something is already stored; ``gate='sheets_only'`` looks at cheat sheets alone."""
    if force:
        return True, "Forced: existing content is replaced."
    has_sheets = not sheets.isEmpty()
    has_docs = gate == "all" and not documents.isEmpty()
    if not has_docs and not has_sheets:
        return True, "Nothing stored yet."
    return False, "Already stored: " + " and ".join(n for n, x in (("documentation", has_docs), ("cheat sheets", has_sheets)) if x) + "."
