"""The three tools: crawl documentation, build cheat sheets, list what is stored."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.config import Config, load_config
from docquarry.functions.classify import categorize
from docquarry.functions.urls import cheatsheet_path, extract_domain_name, is_valid_url, site_key
from docquarry.operators import cheatsheet, crawl, discovery
from docquarry.operators.sections import parse_sections
from docquarry.sources import store
from docquarry.sources.web import fetch_pages


@dataclass
class Answer:
    text: str
    is_error: bool = False
    table: DataFrame | None = None
    details: dict = field(default_factory=dict)


class Documentation:
    """The tools over one store; ``pages(url, html)`` is the page source, without it pages are fetched over HTTP.

    Cheat sheets are stored beside the documents, at ``<base>-sheets``.  ``settings`` gives the
    defaults of the tools' parameters, and the base path where none is named.
    """

    def __init__(self, spark: SparkSession, base: str | None = None, pages: DataFrame | None = None, settings: Config | None = None):
        self.spark, self.pages, self.settings = spark, pages, settings or load_config()
        self.base = base or self.settings.docs_base_path
        self.sheets = f"{self.base}-sheets"

    def _checked(self, url: str) -> None:
        if not self.spark.range(1).select(is_valid_url(F.lit(url))).first()[0]:
            raise ValueError(f"Invalid URL: {url}")

    def _gate(self, url: str, force: bool, gate: str) -> tuple[bool, str]:
        """May the tool go on? Looks for stored content of the same site."""
        if gate not in ("all", "sheets_only"):
            raise ValueError("gate must be all or sheets_only")
        site = self.spark.range(1).select(site_key(F.lit(url))).first()[0]
        same = lambda base: store.read_store(self.spark, base).filter(site_key(F.col("url")) == site)
        return discovery.should_proceed(same(self.base), same(self.sheets), force, gate)

    def crawl_documentation(
        self, url: str, max_depth: int | None = None, force_refresh: bool = False, include_patterns: list[str] | None = None, exclude_patterns: list[str] | None = None, rate_limit: int | None = None, order: str = "breadth"
    ) -> Answer:
        """``rate_limit`` bounds page starts a second where pages are fetched; a page table needs none."""
        self._checked(url)
        limits = replace(self.settings.crawler, **{"default_rate_limit": rate_limit} if rate_limit is not None else {})
        depth = limits.default_max_depth if max_depth is None else max_depth
        go, why = self._gate(url, force_refresh, "all")
        if not go:
            return Answer(why)
        pages = self.pages
        if pages is None:
            pages = crawl.fetch_site(self.spark, url, lambda frontier: fetch_pages(frontier, limits), depth, include_patterns, exclude_patterns)
        got = crawl.crawl_pages(pages, url, depth, include_patterns, exclude_patterns, order).persist()
        home = got.filter("depth = 0").select(F.coalesce(F.first("markdown"), F.lit(""))).first()[0]
        kind, name = self.spark.range(1).select(categorize(F.lit(url), F.lit(home)), extract_domain_name(F.lit(url))).first()
        docs = crawl.last_write_wins(got.filter("error IS NULL"), ["file"], ["depth", "url"]).select(
            F.col("file").alias("path"), "url", "title", F.col("markdown").alias("content"), F.octet_length("markdown").cast("long").alias("bytes"), F.current_timestamp().alias("modified"), F.lit(kind.category).alias("category"), F.lit(name).alias("name")
        )
        store.write_store(docs, self.base)
        links = got.filter("error IS NULL").select(F.col("url").alias("src"), F.explode("links").alias("dst"))
        stats = crawl.crawl_stats(got, links).first().asDict()
        files = [f"{self.base}/{kind.category}/{name}/{r.file}" for r in got.filter("error IS NULL").select("file").distinct().orderBy("file").limit(11).collect()]
        errors = [f"{r.url}: {r.error}" for r in got.filter("error IS NOT NULL").orderBy("url").limit(6).select("url", "error").collect()]
        lines = [f"Crawled {url}", f"Category: {kind.category} (confidence {kind.confidence:.2f})", f"Name: {name}", *(f"{k.capitalize()}: {v}" for k, v in stats.items())]
        lines += ["Files:", *(f"- {f}" for f in files[:10])] + ([f"... and {stats['saved'] - 10} more"] if len(files) > 10 else []) if files else []
        lines += ["Errors:", *(f"- {e}" for e in errors[:5])] + ([f"... and {stats['errors'] - 5} more"] if len(errors) > 5 else []) if errors else []
        return Answer("\n".join(lines), False, got, {**stats, "category": kind.category, "name": name, "reasons": kind.reasons, "files": files[:10], "first_errors": errors[:5]})

    def generate_cheatsheet(
        self, url: str, use_local: bool = True, sections: list[str] | None = None, output_format: str = "single", max_length: int | None = None, force_regenerate: bool = False, gate: str = "sheets_only"
    ) -> Answer:
        """The sheet is stored and its path answered; a stored sheet of the site ends the call unless forced."""
        self._checked(url)
        if not use_local or output_format != "single":
            return Answer("Only stored documentation and single sheets are supported.", True)
        go, why = self._gate(url, force_regenerate, gate)
        if not go:
            return Answer(why)
        kind, name = self.spark.range(1).select(categorize(F.lit(url)), extract_domain_name(F.lit(url))).first()
        docs = store.read_store(self.spark, self.base).filter(F.col("name") == name)
        first = docs.groupBy("category").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "category").first()
        if first is None:
            return Answer(f"No documentation stored for {name}. Crawl it first.", True)
        parsed = parse_sections(docs, "path", "content").withColumn("name", F.lit(name))
        length = max_length or self.settings.cheatsheet.max_length
        sheet = cheatsheet.generate(parsed, ["name"], ["path", "section_pos"], sections, length).first()
        if sheet is None:
            return Answer("No section fits.", True)
        path = self.spark.range(1).select(cheatsheet_path(F.lit(url), F.lit(first.category))).first()[0]
        path = path.removesuffix("-Cheatsheet.md") + self.settings.cheatsheet.filename_suffix
        row = [(path, url, name, sheet.content, len(sheet.content.encode()), None, first.category, name)]
        written = self.spark.createDataFrame(row, store.COLUMNS).withColumn("modified", F.current_timestamp())
        store.write_store(written, self.sheets)
        sources = [r.path for r in docs.select("path").orderBy("path").limit(100).collect()]
        preview = sheet.content.split("\n")
        lines = [f"Cheat Sheet for {url}", f"File: {path}", f"Words: {sheet.word_count}", f"Sections: {len(sheet.titles)}", f"Source files: {sum(r.files for r in docs.groupBy('category').agg(F.count(F.lit(1)).alias('files')).collect())}"]
        lines += [f"- {t}" for t in sheet.titles] + ["", *preview[:20]] + (["..."] if len(preview) > 20 else [])
        return Answer("\n".join(lines), False, written, {"path": path, "content": sheet.content, "titles": sheet.titles, "word_count": sheet.word_count, "sources": sources})

    def list_documentation(self, category: str = "all", include_stats: bool = False) -> Answer:
        if category not in ("all", "tools", "apis"):
            raise ValueError("category must be tools, apis or all")
        stats = store.documentation_stats(store.read_store(self.spark, self.base))
        lines = store.catalog_lines(stats) if include_stats else stats.select("category", "name", F.concat(F.lit("   📄 "), "name").alias("line"))
        rows = lines.orderBy("category", "name").collect()  # one row per documentation set
        out, total = [], 0
        for c in ("tools", "apis"):
            if category in ("all", c):
                own = [r.line for r in rows if r.category == c]
                total += len(own)
                out.append("\n".join([f"\n📂 {c.upper()}:" + ("" if own else " (none)"), *own]))
        return Answer(f"📚 Documentation Summary ({total} total)\n" + "\n".join(out), table=stats)

    def call(self, tool: str, **arguments) -> Answer:
        """Dispatch by name; unknown tools and invalid arguments are error answers."""
        tools = {t: getattr(self, t) for t in ("crawl_documentation", "generate_cheatsheet", "list_documentation")}
        if tool not in tools:
            return Answer(f"Unknown tool: {tool}", True)
        try:
            return tools[tool](**arguments)
        except (TypeError, ValueError) as e:
            return Answer(f"Error: {e}", True)
