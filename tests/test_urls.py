import pytest
from pyspark.sql import functions as F

from docquarry.functions import urls


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://example.com/", "https://example.com"), ("https://example.com/path/", "https://example.com/path"), ("https://example.com/page#section", "https://example.com/page"),
        ("https://example.com?b=2&a=1", "https://example.com?a=1&b=2"), ("not-a-url", "not-a-url"), ("HTTPS://Example.COM:443/a/../b/./c/", "https://example.com/b/c"),
        ("http://u:p@x.io/a?b=1&a=2&b=0", "http://u:p@x.io/a?a=2&b=1&b=0"), ("https://x.io:8080/?z=1", "https://x.io:8080?z=1"), (None, None),
    ],
)
def test_normalize(spark, url, want):
    got = one(spark, urls.normalize_url(F.lit(url).cast("string")))
    assert got == want and one(spark, urls.normalize_url(F.lit(got).cast("string"))) == want


def test_valid(spark):
    table = {"http://localhost:3000": True, "https://example.com": True, "ftp://example.com": False, "": False, "example.com": False}
    assert {u: one(spark, urls.is_valid_url(F.lit(u))) for u in table} == table


def test_absolute(spark):
    base = "https://docs.example.com/guide/"
    table = {"../api": "https://docs.example.com/api", "./basics": "https://docs.example.com/guide/basics", "/docs": "https://docs.example.com/docs", "invalid url": "invalid url", "https://o.io": "https://o.io", "#x": base + "#x", "?q": base + "?q", "//c.io/a": "https://c.io/a", "mailto:a@b": "mailto:a@b", "a/../b#c": base + "b#c"}
    assert {r: one(spark, urls.to_absolute_url(F.lit(base), F.lit(r))) for r in table} == table
    assert one(spark, urls.to_absolute_url(F.lit("bad"), F.lit("x"))) == "x"


def test_same_domain(spark):
    same = lambda a, b: one(spark, urls.is_same_domain(F.lit(a), F.lit(b)))
    assert same("http://docs.n8n.io/a", "https://docs.n8n.io/b") and not same("https://docs.x.io", "https://api.x.io") and not same("invalid", "https://x.io")


def test_names_and_files(spark):
    names = {"https://docs.n8n.io": "n8n", "https://developer.apple.com/documentation/swift": "swift", "https://github.com/org/project/docs": "project", "https://api.service.io/v1": "service", "invalid-url": "unknown", "https://x.io/docs": "x"}
    assert {u: one(spark, urls.extract_domain_name(F.lit(u))) for u in names} == names
    files = {"https://docs.com/api/users": "api_users.md", "https://docs.com": "index.md", "https://docs.com/": "index.md", "https://docs.com/path?query=1": "path.md", "https://docs.com/special!@$%^&*()": "special_________.md", "bad": "unknown.md", "https://x.io/a.md": "a.md"}
    assert {u: one(spark, urls.url_to_filename(F.lit(u))) for u in files} == files


def test_globs(spark):
    hit = lambda u, g: one(spark, urls.matches_patterns(F.lit(u), g))
    assert hit("https://x.io/docs/guide", ["*/docs/*"]) and hit("https://docs.n8n.io/guide", ["https://docs.*.io/*"]) and hit("https://x.io/v1/users", ["*/v*/users"])
    assert not hit("https://x.io/docs/guide", []) and not hit("https://x.io/docs/guide", ["/docs/"]) and hit("https://x.io/a+b", ["*a+?"])


def test_cheatsheet_path(spark):
    path = lambda u, c: one(spark, urls.cheatsheet_path(F.lit(u), F.lit(c), day=F.lit("2024-05-06").cast("date")))
    assert path("https://docs.obsidian.md/plugins/dataview", "tools") == "docs/tools/obsidian/plugins/dataview/obsidian-Cheatsheet.md"
    assert path("https://api.openai.com/v1/chat", "apis") == "docs/apis/openai/v1/chat/openai-Cheatsheet.md"
    assert path("https://developers.google.com/maps", "apis") == "docs/apis/google/maps/google-Cheatsheet.md"
    assert path("https://github.com/A/B_c", "tools") == "docs/tools/github/a/b-c/github-Cheatsheet.md" and path("bad", "tools") == "docs/tools/cheatsheet-2024-05-06.md"


def test_site_match(spark):
    match = lambda a, b: one(spark, urls.is_url_match(F.lit(a), F.lit(b)))
    assert match("https://docs.x.io/a", "https://api.x.io") and match("http://localhost:1", "http://localhost") and not match("https://x.io", "") and not match("https://x.io", "https://y.io")
