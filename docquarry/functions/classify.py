"""Classification of documentation as ``tools`` or ``apis`` from URL and content, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL rules and content terms, in the order in which reasons list them.
API_URL_RULES = (r"\/api\/", r"\/reference\/", r"\/rest\/", r"\/graphql\/", r"\/endpoints?\/", r"\/swagger\/", r"\/openapi\/", r"api\.", r"developers?\.", r"\/v\d+\/")
TOOL_URL_RULES = (
    r"\/docs?\/", r"\/guide\/", r"\/tutorial\/", r"\/getting[_-]?started\/", r"\/learn\/", r"\/manual\/", r"\/handbook\/",
    r"docs\.", r"help\.", r"support\.", r"learn\.", r"\/install", r"\/setup",
)
API_TERMS = (
    "endpoint", "request", "response", "authentication", "authorization", "rate limit", "api key", "access token", "http method", "status code",
    "query parameter", "request body", "response body", "bearer token", "webhook", "rest api", "graphql", "mutation", "subscription",
)
TOOL_TERMS = (
    "installation", "configuration", "workflow", "getting started", "tutorial", "quick start", "how to", "step by step", "user guide", "features",
    "requirements", "dependencies", "cli", "command line", "desktop app", "plugin", "extension", "interface", "settings",
)
API_EXAMPLE = r"""(?i)curl\s+-X\s+(GET|POST|PUT|DELETE|PATCH)|fetch\(['"`].*['"`]\s*,\s*\{[^}]*method:\s*['"`](GET|POST|PUT|DELETE|PATCH)"""
TOOL_EXAMPLE = r"(?i)\$\s+(npm\s+install|yarn\s+add|pip\s+install|brew\s+install)"



def _none() -> Column:
    return F.array().cast("array<string>")


def _hits(text: Column, rules: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(r), F.lit(r)) for r in rules]))


def _result(category, confidence, why: Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(category).alias("category"), as_column(confidence).cast("double").alias("confidence"), why.alias("reasons"))


def _with(value: Column, make) -> Column:
    return F.element_at(F.transform(F.array(value), make), 1)


def analyze_url(url: Column) -> Column:
    """struct(category, confidence, reasons: the rules hit) by the URL alone."""
    lower = F.lower(F.coalesce(url, F.lit("")))

    def make(x: Column) -> Column:
        api, tool = x["api"], x["tool"]
        na, nt = F.size(api), F.size(tool)
        sure = lower.rlike(r"^(https?://)?(api|developer|developers)\.") | lower.rlike(r"/(api|reference|rest|graphql|endpoints?|swagger|openapi)/")
        grade = lambda n: F.least(F.lit(0.8) + n * F.lit(0.1), F.lit(0.95))
        return (
            F.when((na > 0) & (nt > 0) & sure, _result("apis", 0.85, api))
            .when(na > nt, _result("apis", grade(na), api))
            .when((nt > na) & lower.rlike(r"docs\..*/api(?:/|$)"), _result("apis", 0.8, api))
            .when(nt > na, _result("tools", grade(nt), tool))
            .when(na > 0, _result("unknown", 0.5, F.concat(api, tool)))
            .otherwise(_result("unknown", 0.3, _none()))
        )

    return _with(F.struct(_hits(lower, API_URL_RULES).alias("api"), _hits(lower, TOOL_URL_RULES).alias("tool")), make)


def _terms(lower: Column, terms: tuple[str, ...], example: Column, said: str) -> Column:
    counted = [F.when(F.contains(lower, F.lit(t)), F.concat(F.lit(f"{t} ("), F.regexp_count(lower, F.lit(t)).cast("string"), F.lit("x)"))) for t in terms]
    return F.array_compact(F.array(*counted, F.when(example, F.lit(said))))


def analyze_content(content: Column) -> Column:
    """struct(category, confidence, reasons: the terms found with their counts) by the text alone."""
    found = _with(
        F.lower(content),
        lambda low: F.struct(
            _terms(low, API_TERMS, content.rlike(API_EXAMPLE), "REST API examples").alias("api"),
            _terms(low, TOOL_TERMS, content.rlike(TOOL_EXAMPLE), "CLI installation examples").alias("tool"),
        ),
    )

    def make(x: Column) -> Column:
        api, tool = x["api"], x["tool"]
        na, nt = F.size(api), F.size(tool)
        grade = lambda n: F.least(F.lit(0.7) + n * F.lit(0.03), F.lit(0.95))
        return (
            F.when(na > nt * 1.5, _result("apis", grade(na), api))
            .when(nt > na * 1.5, _result("tools", grade(nt), tool))
            .when((na > 0) & (nt > 0), _result("unknown", 0.5, F.concat(api, tool)))
            .otherwise(_result("unknown", 0.3, _none()))
        )

    return _with(found, make)


def combine(url: Column, content: Column) -> Column:
    """One verdict from both analyses; ``content`` is null where there is no text."""

    def said(before: str, values: Column, most: int | None = None) -> Column:
        some = F.slice(values, 1, most) if most else values
        return F.when(F.size(values) > 0, F.concat(F.lit(before), F.array_join(some, ", ")))

    why = lambda *lines: F.array_compact(F.array(*lines))
    u, c = url, content
    known = u["category"] != "unknown"
    alone = F.when(known, _result(u["category"], u["confidence"], why(F.concat(F.lit("URL patterns matched: "), F.array_join(u["reasons"], ", "))))).otherwise(
        _result("tools", 0.3, F.array(F.lit("No clear URL patterns found, defaulting to tools")))
    )
    return (
        F.when(c.isNull(), alone)
        .when(known & (u["category"] == c["category"]), _result(u["category"], F.greatest(u["confidence"], c["confidence"]), why(said("URL patterns: ", u["reasons"]), said("Content indicators: ", c["reasons"], 5))))
        .when(
            (c["confidence"] > u["confidence"]) & (c["category"] != "unknown"),
            _result(c["category"], c["confidence"] * 0.75, why(F.concat(F.lit("Content analysis suggests "), c["category"]), F.concat(F.lit("Content indicators: "), F.array_join(F.slice(c["reasons"], 1, 5), ", ")))),
        )
        .when(known, _result(u["category"], F.least(u["confidence"] * 0.75, F.lit(0.79)), why(F.concat(F.lit("URL analysis suggests "), u["category"]), F.concat(F.lit("URL patterns: "), F.array_join(u["reasons"], ", ")))))
        .otherwise(_result("tools", 0.4, why(F.lit("Uncertain categorization, defaulting to tools"), said("Mixed URL patterns: ", u["reasons"]), said("Mixed content indicators: ", c["reasons"], 3))))
    )


def categorize(url: Column, content: Column | None = None) -> Column:
    """struct(category, confidence, reasons); null or empty content counts as none."""
    text = F.lit(None).cast("string") if content is None else F.when(content != "", content)
    both = F.struct(analyze_url(url).alias("u"), F.when(text.isNotNull(), analyze_content(F.coalesce(text, F.lit("")))).alias("c"))
    return _with(both, lambda x: combine(x["u"], x["c"]))
