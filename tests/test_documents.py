import json
import random

import pytest
from pyspark.sql import functions as F

from docquarry import config
from docquarry.api import Documentation
from docquarry.functions import classify, htmltree
from docquarry.operators import crawl, discovery, facts
from docquarry.operators.cheatsheet import generate
from docquarry.operators.html import parse_pages
from docquarry.operators.sections import filter_sections, parse_sections, prioritize_sections
from docquarry.plans import queries
from docquarry.sources import store

MD = "---\ntitle: x\n---\nlost\n# API Reference\nGET /users\n## Command Line Usage\n```bash\n$ npm install x\n```\n## Example Usage\n## Code Snippets\n\n### Getting Started\nBody text\n"


def verdict(spark, url, content=None):
    return spark.range(1).select(classify.categorize(F.lit(url), F.lit(content).cast("string")).alias("v")).first().v


def test_classification(spark):
    assert tuple(verdict(spark, "https://api.stripe.com/v1/"))[:2] == ("apis", 0.95)
    assert verdict(spark, "https://docs.obsidian.md/guide/start").category == "tools"
    assert verdict(spark, "https://docs.x.com/api")[:2] == ("tools", 0.9) or verdict(spark, "https://docs.x.com/api").category == "apis"
    assert verdict(spark, "https://example.com").reasons == ["No clear URL patterns found, defaulting to tools"]
    agree = verdict(spark, "https://x.com/api/reference/", "The endpoint takes a request with an access token and gives a response with a status code. curl -X GET")
    assert agree.category == "apis" and agree.confidence >= 0.9 and len(agree.reasons) == 2
    against = verdict(spark, "https://x.com/guide/", "endpoint request response webhook graphql")
    assert against.category == "tools" and abs(against.confidence - 0.675) < 1e-9
    assert verdict(spark, "https://x.com", "").confidence == 0.3 and verdict(spark, "https://x.com", "nothing").confidence == 0.4


def test_sections(spark):
    rows = parse_sections(spark.createDataFrame([(1, MD), (2, None), (3, ""), (4, "---\nnever closed\n# A\nb"), (5, "# A\r\nb\n#B\n# C\n")], "doc_id long, md string")).orderBy("doc_id", "section_pos").collect()
    assert [(r.doc_id, r.title, r.type, r.level, r.content) for r in rows] == [
        (1, "API Reference", "api", 1, "GET /users"), (1, "Command Line Usage", "command", 2, "```bash\n$ npm install x\n```"), (1, "Code Snippets", "code", 2, ""), (1, "Getting Started", "text", 3, "Body text"), (5, "C", "text", 1, ""),
    ]
    assert [r.priority for r in rows if r.doc_id == 1] == [14.0, 21.0, 0.0, 10.0]
    assert {r.title for r in filter_sections(parse_sections(spark.createDataFrame([(1, MD)], "doc_id long, md string")), ["started", "api"]).collect()} == {"API Reference", "Getting Started"}


@pytest.mark.parametrize("limit", [1000, 500, 437, 300, 250])
def test_budget_equals_greedy_loop(spark, limit):
    rows = [(i % 3, i, f"t{i}", "x" * (i * 37 % 190), float(i * 7 % 5)) for i in range(60)]
    want = []
    for g in range(3):
        total = 200
        for _, i, t, c, _p in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4], r[1])):
            cost = len(t) + len(c) + 50
            if total + cost <= limit:
                want.append((g, i, c))
                total += cost
            else:
                if limit - total - 100 > 100:
                    want.append((g, i, c[: limit - total - 100] + "..."))
                break
    got = prioritize_sections(spark.createDataFrame(rows, "doc_id int, section_pos int, title string, content string, priority double"), limit)
    assert sorted((r.doc_id, r.section_pos, r.content) for r in got.collect()) == sorted(want)


PAGE = """<html><head><title>T &amp; x</title></head><body><nav><a href="/n">N</a></nav><main><h1>Hello <b>World</b></h1><p>One <code>x</code> <em>two</em>
<p>Three <a href="../b" title="t">link</a><ul><li>A<ul><li>B</li></ul></li><li>C</ul><ol><li>First item</ol><pre><code class="language-bash">npm i

x</code></pre><div class="alert warning">Mind
 this</div><table><tr><th>H|1<th>H2<tr><td><code>a</code> b<td>c</table><script>x</p></script><hr></main><a href="#z">z</a><a href="javascript:1">j</a><a href="/n">again</a></body>"""


def test_html():
    found = htmltree.page(PAGE, "https://x.io/docs/a")
    assert found["title"] == "Hello World" and found["links"] == ["https://x.io/n", "https://x.io/b"] and found["error"] is None
    md = found["markdown"]
    for part in ("# Hello **World**", "One `x` *two*", 'Three [link](../b "t")', "-   A\n    -   B\n-   C", "1.  First item", "```bash\nnpm i\n\nx\n```", "> ⚠️ Mind\n> ⚠️ this", "| H\\|1 | H2 |\n| --- | --- |\n| `a` b | c |"):
        assert part in md, (part, md)
    assert "N" not in md.split("\n")[0] and "script" not in md
    assert htmltree.page(None, None) == {"title": "Untitled", "links": [], "markdown": "", "error": "No content extracted"}
    assert htmltree.page("<title>only</title><p>a<p>b", "")["title"] == "only"


def test_titles_equal_their_sql(spark, tmp_path):
    import duckdb

    html = ["<h1>A &amp;&amp;&amp</h1>", "<title>x &ampamp; &lt;b&gt; &#39;</title>", "<h1></h1><title>R&D; &amp y &copy</title>", "<h1>&amp;lt; &quot;&ltq</h1>", "", None]
    spark.createDataFrame([(i, "https://x.io/", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(db.execute(queries.ORACLE_SQL["h1_titles"]).fetchall())
    assert sorted(tuple(r) for r in queries.page_titles(spark, str(tmp_path)).collect()) == want
    assert htmltree.page("<h1>A &amp;&amp</h1>", "")["title"] == "A &&"


def test_pages_are_read_in_pieces():
    import pyarrow as pa

    from docquarry.operators.html import _pieces

    html = ["x" * 300, None, "é" * 300, "", "y" * 2000, "z" * 10]
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(html)], ["n", "html"])
    got = list(_pieces(iter([b.slice(0, 0), b]), 1, 1000))
    assert [p.num_rows for p in got] == [4, 1, 1] and [x for p in got for x in p.column(1).to_pylist()] == html


def test_functions():
    text = "`<% tp.date.now() %>` - Gives the date of today\nGET /users/{id} is used\n\n```\nfunction go(a) {\n```\nRun `git status` now and again\n$ npm install x"
    got = {(f["name"], f["syntax"]) for f in facts.functions_in(text)}
    assert {("now", "<% tp.date.now() %>"), ("/users/{id}", "GET /users/{id}"), ("go", "function go(a)"), ("git status", "`git status`")} <= got
    assert facts.functions_in(None) == []


def test_sheet(spark):
    md = "# Widget Guide\nUsing it.\n## Getting Started\nThis sentence is long enough to describe what the widget tool is for. Rest.\n**Term**: the definition is here\n> Always read the whole manual first\n## API\nGET /users/all lists them\n```bash\n$ npm install widget\n```\n| A | B |\n|---|---|\n| 1 | 2 |\n"
    sheet = generate(parse_sections(spark.createDataFrame([(1, md)], "doc_id long, md string")), updated="1/2/2024").first()
    for part in ("# Widget: Cheat Sheet\n\nThis sentence is long", "## Key Concepts\n\n- **Term**: the definition is here", "### API Endpoints", "| /users/all | `GET /users/all` |", "### Command Line Usage\n\n```bash\n$ npm install widget\n```", "## Reference Tables\n\n| A | B |", "- Always read the whole manual first", "*Last updated: 1/2/2024*"):
        assert part in sheet.content, (part, sheet.content)


def test_crawl(spark):
    links = spark.createDataFrame([("s", "r", "a", 0), ("s", "r", "b", 1), ("s", "a", "b", 0), ("s", "b", "c", 0)], "site string, src string, dst string, pos int")
    bfs = crawl.crawl_levels(spark.createDataFrame([("r",)], "url string"), links, 2)
    assert {(r.url, r.depth) for r in bfs.collect()} == {("r", 0), ("a", 1), ("b", 1), ("c", 2)}
    dfs = crawl.crawl_depth_first(spark.createDataFrame([("s", "r")], "site string, url string"), links, 2)
    # b is met below a, at the depth limit, so its own links are never followed.
    assert [(r.url, r.depth) for r in dfs.orderBy("visit").collect()] == [("r", 0), ("a", 1), ("b", 2)]
    g = random.Random(3)
    edges = [("s", str(a), str(b), k) for a in range(30) for k, b in enumerate(g.sample(range(30), 3))]

    def model(limit):
        out, visited, found = [], set(), set()

        def visit(url, depth):
            if url in visited or depth > limit:
                return
            visited.add(url)
            out.append((url, depth))
            for _, src, dst, _ in edges if depth < limit else []:
                if src == url and dst not in found:
                    found.add(dst)
                    visit(dst, depth + 1)

        visit("0", 0)
        return out

    table = spark.createDataFrame(edges, "site string, src string, dst string, pos int")
    for limit in (0, 1, 3, 9):
        walked = crawl.crawl_depth_first(spark.createDataFrame([("s", "0")], "site string, url string"), table, limit)
        assert [(r.url, r.depth) for r in walked.orderBy("visit").collect()] == model(limit)
    with pytest.raises(ValueError, match="negative"):
        crawl.crawl_levels(spark.createDataFrame([("r",)], "url string"), links, -1)


def test_tools(spark, tmp_path):
    body = lambda t, links: f"<main><h1>{t}</h1><p>The endpoint takes a request.</p>{links}</main>"
    pages = spark.createDataFrame(
        [("https://docs.w.io/", body("Home", '<a href="/guide/a">A</a><a href="/guide/b">B</a><a href="https://other.io/">o</a>')), ("https://docs.w.io/guide/a", body("Guide", '<a href="/guide/b">B</a>')), ("https://docs.w.io/guide/b", body("B", '<a href="/guide/c">c</a>')), ("https://docs.w.io/guide/c", body("C", "")), ("https://docs.w.io/guide/x", body("Unlinked", ""))],
        "url string, html string",
    )
    tools = Documentation(spark, f"{tmp_path}/store", pages)
    first = tools.call("crawl_documentation", url="https://docs.w.io/", max_depth=2, rate_limit=5)
    assert not first.is_error and first.details["saved"] == 4 and first.details["name"] == "w" and first.details["discovered"] == 4
    assert len(first.details["files"]) == 4 and "Discovered: 4" in first.text and first.details["first_errors"] == []
    for again in ("https://docs.w.io/", "http://docs.w.io", "https://www.w.io/other"):  # one site, however it is written
        assert "Already stored" in tools.call("crawl_documentation", url=again).text
    deep = tools.call("crawl_documentation", url="https://docs.w.io/", max_depth=2, order="depth", force_refresh=True)
    assert deep.details["saved"] == 3  # B is met below A, so C is too deep
    assert tools.call("crawl_documentation", url="https://docs.w.io/", rate_limit=0, force_refresh=True).is_error
    few = tools.call("crawl_documentation", url="https://docs.w.io/", max_depth=1, exclude_patterns=["*/b"], force_refresh=True)
    assert few.details["saved"] == 2
    sheet = tools.call("generate_cheatsheet", url="https://docs.w.io/")
    assert "Cheat Sheet" in sheet.text and sheet.details["path"].endswith("w-Cheatsheet.md") and len(sheet.details["sources"]) == 2
    stored = store.read_store(spark, tools.sheets).first()
    assert stored.content == sheet.details["content"] and stored.path == sheet.details["path"]
    assert "Already stored" in tools.call("generate_cheatsheet", url="https://docs.w.io/").text
    assert "Cheat Sheet" in tools.call("generate_cheatsheet", url="https://docs.w.io/", force_regenerate=True).text
    assert "📄 w (" in tools.call("list_documentation", include_stats=True).text
    assert tools.call("nothing").is_error and tools.call("crawl_documentation", url="ftp://x").is_error
    for row in store.read_store(spark, tools.base).select("category", "name").distinct().collect():
        store.delete_documentation(spark, tools.base, row.category, row.name)
    assert store.read_store(spark, tools.base).count() == 0


def test_settings_are_used(spark, tmp_path):
    settings = config.Config(f"{tmp_path}/base", config.Crawler(default_max_depth=1), config.Cheatsheet(max_length=1000, filename_suffix="-Sheet.md"))
    page = lambda t, to: f"<main><h1>{t}</h1><p>{'word ' * 100}</p><a href='{to}'>n</a></main>"
    pages = spark.createDataFrame([("https://docs.v.io/", page("Home", "/a")), ("https://docs.v.io/a", page("A", "/b")), ("https://docs.v.io/b", page("B", "/"))], "url string, html string")
    tools = Documentation(spark, None, pages, settings)
    assert tools.base == f"{tmp_path}/base" and tools.call("crawl_documentation", url="https://docs.v.io/").details["saved"] == 2
    sheet = tools.call("generate_cheatsheet", url="https://docs.v.io/")
    assert sheet.details["path"].endswith("-Sheet.md") and len(sheet.details["titles"]) == 2


def test_files(spark, tmp_path):
    (tmp_path / "tools/x").mkdir(parents=True)
    (tmp_path / "tools/x/a.md").write_text("Original: https://docs.x.io/a b")
    (tmp_path / "tools/x/x-Cheatsheet.md").write_text("## One\nSource: https://x.io/q\n`f(x)`\n## Two\n")
    files = store.read_markdown(spark, str(tmp_path)).withColumn("category", F.lit("tools"))
    assert store.read_markdown(spark, f"{tmp_path}/none").count() == 0
    targets = spark.createDataFrame([("https://api.x.io",)], "target string")
    assert {r.url for r in discovery.find_documentation(files, targets).collect()} == {"https://docs.x.io/a", "https://x.io/q"}
    sheet = discovery.find_cheatsheets(files).first()
    assert (sheet.url, sheet.sections, sheet.function_count) == ("https://x.io/q", ["One", "Two"], 1)
    assert "- Functions: ~1 entries" in discovery.describe(discovery.find_cheatsheets(files)).first().entry
    assert discovery.should_proceed(files, files) == (False, "Already stored: documentation and cheat sheets.") and discovery.should_proceed(files, files, True)[0]


def test_config(tmp_path, monkeypatch):
    text = '{ // c\n "docsBasePath": "d", "crawler": {"defaultMaxDepth": 2, "userAgent": "a (+https://x.io)",}, /* z */ }'
    (tmp_path / "c.json").write_text(text)
    config.clear_config_cache()
    got = config.load_config(str(tmp_path / "c.json"))
    assert (got.docs_base_path, got.crawler.default_max_depth, got.crawler.user_agent, got.cheatsheet.max_length) == ("d", 2, "a (+https://x.io)", 10_000)
    config.clear_config_cache()
    monkeypatch.setenv("DOCS_BASE_PATH", "/e")
    assert config.load_config(str(tmp_path / "none.json")).docs_base_path == "/e"
    assert json.loads(config.strip_comments('{"a": "x // y",}')) == {"a": "x // y"}
    with pytest.raises(ValueError, match="at least 1"):
        config.Crawler(default_rate_limit=0)
    config.clear_config_cache()


def test_stream(spark, tmp_path):
    from docquarry.streaming.ingest import append_pages, fresh_pages, read_pages

    spark.createDataFrame([("https://x.io/a/", "1"), ("https://x.io/a#z", "2"), ("https://x.io/b", "3")], "url string, html string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    append_pages(fresh_pages(read_pages(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert parse_pages(spark.read.parquet(f"{tmp_path}/out")).count() == 2
