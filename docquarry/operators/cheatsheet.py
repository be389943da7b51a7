"""Cheat sheets: one Markdown text per group of sections, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators import facts
from docquarry.operators.sections import filter_sections, prioritize_sections

CONCEPTS, FUNCTIONS, EXAMPLES, TABLES, TIPS = 8, 10, 5, 3, 8  # most of each that a sheet shows


def _block(title: str, lines: Column, shown: Column) -> Column:
    return F.when(shown, F.concat(F.lit(f"## {title}\n\n"), F.array_join(lines, "\n")))


def render_header(name: Column, description: Column) -> Column:
    return F.concat(F.lit("# "), name, F.lit(": Cheat Sheet\n\n"), description, F.lit("\n\n---"))


def render_concepts(concepts: Column) -> Column:
    lines = F.transform(F.slice(concepts, 1, CONCEPTS), lambda c: F.concat(F.lit("- **"), c["term"], F.lit("**: "), c["definition"]))
    return _block("Key Concepts", lines, F.size(concepts) > 0)


def render_functions(functions: Column) -> Column:
    """A table for each module, the modules in order of first sight; rows with an empty cell are left out."""
    tagged = F.transform(functions, lambda f: F.struct(facts.function_module(f["syntax"]).alias("module"), f["name"].alias("name"), f["syntax"].alias("syntax"), f["description"].alias("description")))
    modules = F.array_distinct(F.transform(tagged, lambda f: f["module"]))

    def row(f: Column) -> Column:
        cells = [facts.escape_table_cell(f["name"]), facts.escape_table_cell(facts.clean_syntax(f["syntax"])), facts.escape_table_cell(facts.clean_description(f["description"]))]
        return F.when((cells[0] != "") & (cells[2] != ""), F.concat(F.lit("| "), cells[0], F.lit(" | `"), cells[1], F.lit("` | "), cells[2], F.lit(" |")))

    def table(m: Column) -> Column:
        own = F.slice(F.filter(tagged, lambda f: f["module"] == m), 1, FUNCTIONS)
        rows = F.array_compact(F.transform(own, row))
        return F.array_join(F.concat(F.array(F.concat(F.lit("\n### "), m, F.lit("\n\n| Function | Syntax | Description |\n|---|---|---|"))), rows), "\n")

    return F.when(F.size(functions) > 0, F.concat(F.lit("## Common Functions\n"), F.array_join(F.transform(modules, table), "\n")))


def render_examples(examples: Column) -> Column:
    lines = F.transform(F.slice(examples, 1, EXAMPLES), lambda e: F.concat(F.lit("### "), e["title"], F.lit("\n\n```"), e["language"], F.lit("\n"), e["code"], F.lit("\n```\n")))
    return _block("Quick Examples", lines, F.size(examples) > 0)


def render_tables(tables: Column) -> Column:
    return F.when(F.size(tables) > 0, F.concat(F.lit("## Reference Tables\n\n"), F.array_join(F.slice(tables, 1, TABLES), "\n\n")))


def render_tips(tips: Column) -> Column:
    return _block("Best Practices and Tips", F.transform(F.slice(tips, 1, TIPS), lambda t: F.concat(F.lit("- "), t)), F.size(tips) > 0)


def generate(sections: DataFrame, group: list[str] | None = None, order: list[str] | None = None, names: list[str] | None = None, max_length: int = 10_000, updated: str = "") -> DataFrame:
    """(group, content, titles, word_count): a sheet from each group's best sections within the budget.

    The input budget bounds what one group can gather, so the aggregation is bounded too.
    """
    group, order = group or ["doc_id"], order or ["doc_id", "section_pos"]
    kept = prioritize_sections(filter_sections(sections, names) if names else sections, max_length, group, order)
    sheet = kept.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("rank", "title", "content"))).alias("s"))
    bodies = F.transform("s", lambda x: x["content"])
    each = lambda make: F.flatten(F.transform(bodies, make))
    intro = F.filter("s", lambda x: facts.is_introduction(x["title"]))
    sheet = sheet.withColumn("text", F.array_join(bodies, "\n\n")).withColumn("titled", F.array_join(F.transform("s", lambda x: F.concat(x["title"], F.lit(" "), x["content"])), " "))
    sheet = sheet.withColumn("functions", facts.extract_functions("text"))
    description = F.coalesce(facts.description_of(F.try_element_at(intro, F.lit(1))["content"]), F.lit(facts.STOCK_DESCRIPTION))
    footer = F.lit("---\n\n*Generated by docquarry*" + (f"\n*Last updated: {updated}*" if updated else ""))
    content = F.concat_ws(
        "\n\n",
        render_header(facts.infer_tool_name(F.col("titled")), description),
        render_concepts(facts.extract_concepts(F.col("text"))),
        render_functions(F.col("functions")),
        render_examples(each(facts.extract_code_examples)),
        render_tables(facts.extract_tables(F.col("text"))),
        render_tips(F.array_distinct(each(facts.extract_best_practices))),
        footer,
    )
    return sheet.select(*group, content.alias("content"), F.transform("s", lambda x: x["title"]).alias("titles")).withColumn("word_count", F.size(F.split("content", r"\s+", -1)))
