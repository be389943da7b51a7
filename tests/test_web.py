import http.server
import threading

from docquarry.config import Crawler
from docquarry.operators.crawl import fetch_site
from docquarry.operators.html import parse_pages
from docquarry.sources import store
from docquarry.sources.web import fetch_pages


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        pages = {"/robots.txt": "User-agent: *\nDisallow: /private", "/": "<main><h1>Home</h1><a href='/next'>n</a><a href='/none'>m</a></main>", "/next": "<main><h1>Next</h1></main>", "/private/x": "secret"}
        body = pages.get(self.path)
        self.send_response(200 if body else 404)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write((body or "").encode())

    def log_message(self, *a):
        pass


def test_fetch(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = [(f"{base}/",), (f"{base}/",), (f"{base}/private/x",), (f"{base}/none",), ("ftp://x.io/a",), (None,)]
    got = {r.url: r for r in fetch_pages(spark.createDataFrame(rows, "url string"), Crawler(default_rate_limit=10), 2).collect()}
    site = fetch_site(spark, f"{base}/", lambda frontier: fetch_pages(frontier, Crawler(default_rate_limit=10), 2), 2)
    assert {(r.url, r.html is not None) for r in site.collect()} == {(base, True), (f"{base}/next", True), (f"{base}/none", False)}
    server.shutdown()
    assert len(got) == 4 and "Home" in got[f"{base}/"].html and got[f"{base}/"].error is None
    assert got[f"{base}/private/x"].error == "disallowed by robots.txt" and "404" in got[f"{base}/none"].error and got["ftp://x.io/a"].error == "not an HTTP URL"
    assert parse_pages(spark.createDataFrame([(base, got[f"{base}/"].html)], "url string, html string")).first().title == "Home"


def test_export(spark, tmp_path):
    docs = spark.createDataFrame([("tools", "x", "a.md", "one"), ("apis", "y", "b.md", "two")], "category string, name string, path string, content string")
    store.export_markdown(docs, str(tmp_path))
    assert {(r.path[-4:], r.content) for r in store.read_markdown(spark, str(tmp_path)).collect()} == {("a.md", "one"), ("b.md", "two")}
