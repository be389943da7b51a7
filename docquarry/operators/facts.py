"""Facts from section texts: functions, concepts, tables, examples, tips, names and descriptions.

All but ``extract_functions`` are Column expressions over one text.  Order is kept
in arrays (pattern by pattern, then position), so nothing depends on partitions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns, in the order in which they are tried.
CONCEPTS = (r"(?m)^\*\*([^*]+)\*\*:\s*(.+)$", r"(?m)^-\s*\*\*([^*]+)\*\*:\s*(.+)$", r"(?m)^([A-Z][a-zA-Z\s]+):\s*(.+)$")
TIPS = (r"(?i)(?:Tip|Note|Best Practice|Important|Remember):\s*(.+)", r"💡\s*(.+)", r"⚠️\s*(.+)", r"(?m)^>\s*(.+)$")
TABLE = r"(?m)^\|[^\n]*\|[^\n]*\|[ \t]*\n\|[ \t:|\-]+\|[ \t]*(?:\n\|[^\n]*\|[ \t]*)*"
FENCE = r"```(\w+)?\n([\s\S]*?)```"
NAMES = (r"([A-Z][a-zA-Z]+)\s+(?:API|Documentation|Guide)", r"^([A-Z][a-zA-Z]+):", r"Using\s+([A-Z][a-zA-Z]+)")
DESCRIBED = (r"`([^`]*<%[^%]*%>[^`]*)`\s*-\s*(.+?)(?:\n|\Z)", r"`([^`]*tp\.[^`]+)`\s*-\s*(.+?)(?:\n|\Z)")
NAMED = (
    r"(?:GET|POST|PUT|DELETE|PATCH)\s+([/\w\-{}:]+)", r"curl\s+.*?([/\w\-{}:]+)", r"(?:function|def|const|let|var)\s+(\w+)\s*\([^)]*\)",
    r"(\w+)\s*\([^)]*\)\s*[{=>]", r"`([a-zA-Z0-9\-_]+(?:\s+[a-zA-Z0-9\-_]+)*)`", r"\$\s+([a-zA-Z0-9\-_\s]+)",
)
STOCK_DESCRIPTION = "Quick reference guide for essential functions and commands."
MODULES = (("tp.date", "Date Module (tp.date)"), ("tp.file", "File Module (tp.file)"), ("tp.system", "System Module (tp.system)"), ("tp.user", "User Functions (tp.user)"))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def _between(c: Column, low: int, high: int) -> Column:
    return (F.length(c) > low) & (F.length(c) < high)


def extract_concepts(text: Column) -> Column:
    """array<struct<term, definition>>"""

    def of(pattern: str) -> Column:
        pair = lambda a, b: F.struct(_trim(a).alias("term"), _trim(b).alias("definition"))
        found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2), pair)
        return F.filter(found, lambda x: _between(x["term"], 2, 50) & (F.length(x["definition"]) > 10))

    return F.concat(*map(of, CONCEPTS))


def extract_tables(text: Column) -> Column:
    """array<string> of pipe tables with a separator row."""
    return F.transform(F.regexp_extract_all(text, F.lit(TABLE), 0), _trim)


def example_title(code: Column, language: Column) -> Column:
    has = lambda s: F.contains(code, F.lit(s))
    return (
        F.when((language == "bash") | has("$"), "Command Line Usage")
        .when((language == "javascript") | has("function"), "JavaScript Example")
        .when((language == "json") | F.startswith(code, F.lit("{")), "JSON Structure")
        .when(has("curl"), "API Request")
        .when(has("npm") | has("install"), "Installation")
        .otherwise("Code Example")
    )


def extract_code_examples(text: Column) -> Column:
    """array<struct<title, code, language>>; the language is empty where the fence names none."""

    def example(language: Column, code: Column) -> Column:
        lang = F.coalesce(language, F.lit(""))
        return F.struct(example_title(_trim(code), lang).alias("title"), _trim(code).alias("code"), lang.alias("language"))

    found = F.zip_with(F.regexp_extract_all(text, F.lit(FENCE), 1), F.regexp_extract_all(text, F.lit(FENCE), 2), example)
    return F.filter(found, lambda x: _between(x["code"], 10, 500))


def extract_best_practices(text: Column) -> Column:
    """array<string> of tips, in the order found, each once."""
    found = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), 1), _trim) for p in TIPS])
    return F.array_distinct(F.filter(found, lambda x: _between(x, 20, 200)))


def function_module(syntax: Column) -> Column:
    has = lambda s: F.contains(syntax, F.lit(s))
    out = F.when(has(MODULES[0][0]), MODULES[0][1])
    for mark, name in MODULES[1:]:
        out = out.when(has(mark), name)
    return (
        out.when(has("<%") & has("%>"), "Template Commands")
        .when(has("GET") | has("POST"), "API Endpoints")
        .when(has("$") | has("npm") | has("curl"), "CLI Commands")
        .when(has("git"), "Git Commands")
        .otherwise("General")
    )


def infer_tool_name(text: Column) -> Column:
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in NAMES]
    return F.coalesce(*found, F.lit("Documentation"))


def is_introduction(title: Column) -> Column:
    t = F.lower(title)
    return F.contains(t, F.lit("introduction")) | F.contains(t, F.lit("overview")) | F.contains(t, F.lit("getting started"))


def description_of(intro: Column) -> Column:
    """First suitable sentence of an introduction; null where there is none."""
    clean = F.transform(F.split(intro, "[.!?]+", -1), lambda s: F.regexp_replace(_trim(s), r"^[*\-+]\s*", ""))
    good = F.filter(clean, lambda s: _between(s, 50, 300) & ~F.contains(s, F.lit("`")))
    return F.concat(F.try_element_at(good, F.lit(1)), F.lit("."))


def clean_syntax(c: Column) -> Column:
    return _trim(F.substring(F.regexp_replace(F.regexp_replace(c, r"^\$\s+", ""), r"^curl\s+", "curl "), 1, 50))


def clean_description(c: Column) -> Column:
    return _trim(F.substring(F.regexp_replace(F.regexp_replace(c, r"^[*\-+]\s*", ""), r"\[([^\]]+)\]\([^)]+\)", "$1"), 1, 80))


def escape_table_cell(c: Column) -> Column:
    return _trim(F.replace(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")))


def describe_at(lines: list[str], line: int) -> str:
    """First plain line from three above to three below."""
    for raw in lines[max(0, line - 3) : line + 4]:
        text = raw.strip()
        if len(text) > 10 and "`" not in text and not text.startswith("#"):
            return re.sub(r"^[*\-+]\s*", "", text).strip()
    return "Function or command"


def functions_in(text: str | None) -> list[dict]:
    """Functions and commands of one text: described ones first, then by pattern; one for each name and syntax."""
    if not text:
        return []
    found: dict[tuple[str, str], dict] = {}
    for pattern in DESCRIBED:
        for m in re.finditer(pattern, text):
            syntax, said = m[1].strip(), m[2].strip()
            if len(syntax) <= 5 or len(said) <= 10:
                continue
            call, tag = re.search(r"tp\.(\w+)\.(\w+)", syntax), re.search(r"%[^%]*%", syntax)
            name = (call[2] if call else tag[0] if tag else syntax[:20]).strip()
            entry = found.setdefault((name, syntax), {"name": name, "syntax": syntax, "description": said})
            entry["description"] = max(entry["description"], said, key=len)
    lines = text.split("\n")
    for pattern in NAMED:
        for m in re.finditer(pattern, text, re.ASCII):
            if 1 < len(m[1]) < 50:
                name, syntax = m[1].strip(), m[0].strip()
                found.setdefault((name, syntax), {"name": name, "syntax": syntax, "description": describe_at(lines, text.count("\n", 0, m.start()))})
    return list(found.values())


_FUNCTIONS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "syntax", "description")]))


@F.pandas_udf(_FUNCTIONS)
def extract_functions(texts: pd.Series) -> pd.Series:
    return texts.map(functions_in)


def functions_by_module(functions: DataFrame, group: list[str], most: int = 10) -> DataFrame:
    """Rows (group, pos, name, syntax, description) with their module, the modules in order of first sight, ``most`` each."""
    f = functions.withColumn("module", function_module(F.col("syntax")))
    first = Window.partitionBy(*group, "module")
    f = f.withColumn("module_pos", F.min("pos").over(first)).withColumn("place", F.row_number().over(first.orderBy("pos")))
    return f.filter(F.col("place") <= most)
