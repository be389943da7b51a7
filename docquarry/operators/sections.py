"""Markdown sections: parsing, types, priorities, filtering and the length budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Title phrases worth ten points each, patterns worth three and four per match.
TITLE_PHRASES = ("quick start", "getting started", "installation", "setup", "api reference", "commands", "usage", "examples")
COMMANDS = (r"\$\s+\w+", r"npm \w+", r"curl\s+", r"git \w+")
API_MARKS = (r"https?://[^\s)]+", "GET|POST|PUT|DELETE", r"/api/[^\s)]+")
HEADER_LENGTH, PADDING, MARGIN = 200, 50, 100

_HEADING = r"^(#{1,6})\s+(.+)\z"


def content_type(title: Column) -> Column:
    t = F.lower(title)
    has = lambda *words: F.greatest(*[F.contains(t, F.lit(w)) for w in words])
    return F.when(has("api", "endpoint"), "api").when(has("command", "cli"), "command").when(has("example", "usage"), "example").when(has("code", "snippet"), "code").otherwise("text")


def priority(title: Column, body: Column) -> Column:
    """Points of a section, from its title and its untrimmed body; fractional where a code fence is left open."""
    t = F.lower(title)
    total = sum((F.when(F.contains(t, F.lit(p)), 10.0).otherwise(0.0) for p in TITLE_PHRASES), F.lit(0.0))
    total += F.regexp_count(body, F.lit("```")) * 2.5
    for points, patterns in ((3.0, COMMANDS), (4.0, API_MARKS)):
        for p in patterns:
            total += F.regexp_count(body, F.lit(p)) * points
    tokens = F.size(F.split(body, r"\s+", -1))
    return total + F.when((tokens > 10) & (tokens < 200), 2.0).otherwise(0.0)


def parse_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "md") -> DataFrame:
    """(id, section_pos, title, content, type, level, priority): one row for each heading that has lines below it.

    A front matter block is skipped (the whole text, if it is never closed); text
    before the first heading is not part of any section; ``#`` lines in code fences
    are headings.  The lines of a document are folded inside its own row, so no
    shuffle is needed.  Null texts have no sections; repeated rows each have theirs.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    closing = F.array_position(F.transform(F.slice(lines, 2, 10_000_000), lambda x: F.trim(x)), "---")
    front = F.trim(F.element_at(lines, 1)) == "---"
    body = F.when(front & (closing > 0), F.slice(lines, (closing + 2).cast("int"), F.size(lines))).when(front, F.array().cast("array<string>")).otherwise(lines)
    heads = F.filter(F.transform(F.col("lines"), lambda x, i: F.when(x.rlike(_HEADING), i)), lambda i: i.isNotNull())
    span = F.transform(
        F.col("heads"),
        lambda i, k: F.struct(i.alias("at"), (F.coalesce(F.get(F.col("heads"), k + 1), F.size("lines")) - i - 1).alias("n")),
    )
    return (
        docs.select(F.col(id_col), body.alias("lines"))
        .withColumn("heads", heads)
        .select(id_col, "lines", F.posexplode(span).alias("heading", "span"))
        .filter("span.n > 0")
        .select(
            id_col,
            F.col("heading").alias("section_pos"),
            F.get("lines", F.col("span.at")).alias("line"),
            F.array_join(F.slice("lines", F.col("span.at") + 2, F.col("span.n")), "\n").alias("body"),
        )
        .select(id_col, "section_pos", F.trim(F.regexp_extract("line", _HEADING, 2)).alias("title"), F.length(F.regexp_extract("line", _HEADING, 1)).alias("level"), "body")
        .select(id_col, "section_pos", "title", F.regexp_replace("body", r"^\s+|\s+\z", "").alias("content"), content_type(F.col("title")).alias("type"), "level", priority(F.col("title"), F.col("body")).alias("priority"))
    )


def filter_sections(sections: DataFrame, names: list[str]) -> DataFrame:
    """Sections whose title holds any of the names, in any case."""
    t = F.lower(F.col("title"))
    keep = F.lit(False)
    for n in names:
        keep = keep | F.contains(t, F.lit(n.lower()))
    return sections.filter(keep)


def prioritize_sections(sections: DataFrame, max_length: int = 10_000, group: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Each group's best sections within the length budget; the first that does not fit is cut if over 100 characters are left.

    Costs are positive, so the running total decides, and the greedy loop is one
    window per group.  A section costs ``PADDING`` at least, so only so many of a group's
    best can fit; the others are dropped before the shuffle.  ``order`` breaks ties of priority.
    """
    group, order = group or ["doc_id"], order or ["doc_id", "section_pos"]
    best = Window.partitionBy(*group).orderBy(F.desc("priority"), *order)
    sections = sections.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max(0, max_length - HEADER_LENGTH) // PADDING + 1)
    w = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.length("title") + F.length("content") + PADDING
    ranked = sections.withColumn("_cost", cost).withColumn("_total", F.sum("_cost").over(w) + HEADER_LENGTH)
    room = F.lit(max_length) - (F.col("_total") - F.col("_cost")) - MARGIN
    fits = F.col("_total") <= max_length
    first_out = ~fits & (F.col("_total") - F.col("_cost") <= max_length) & (room > 100)
    cut = F.concat(F.substring(F.col("content"), F.lit(1), room.cast("int")), F.lit("..."))
    return ranked.filter(fits | first_out).withColumn("content", F.when(fits, F.col("content")).otherwise(cut)).withColumn("truncated", ~fits).drop("_cost", "_total")
