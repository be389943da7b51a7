"""URL functions as Column expressions.

A URL is scheme://[user@]host[:port][/path][?query][#fragment].  Scheme and host
are lower-cased, default ports dropped, dot segments resolved and blanks in the
path percent-encoded; internationalised hosts are left as they are.  Null in,
null out, except where a function states another result for invalid input.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@\s]*)@)?([^/?#:@\s]+)(?::([0-9]*))?((?:/[^?#]*)?)((?:\?[^#]*)?)((?:#.*)?)$"


def resolved(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    segments = F.slice(F.split(path, "/", -1), 2, 100_000)
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    slash = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), slash)).otherwise(path)


def parts(url: Column) -> Column:
    """struct(ok, scheme, user, host, port, path, query, fragment); query and fragment keep their mark."""
    group = lambda i: F.regexp_extract(url, _URL, i)
    scheme, port = F.lower(group(1)), group(4)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    raw = F.when(group(5) == "", F.lit("/")).otherwise(F.replace(group(5), F.lit(" "), F.lit("%20")))
    return F.struct(
        F.coalesce(url.rlike(_URL), F.lit(False)).alias("ok"),
        scheme.alias("scheme"),
        group(2).alias("user"),
        F.lower(group(3)).alias("host"),
        F.when(default, F.lit("")).otherwise(port).alias("port"),
        resolved(raw).alias("path"),
        F.when(group(6) == "?", F.lit("")).otherwise(group(6)).alias("query"),
        F.when(group(7) == "#", F.lit("")).otherwise(group(7)).alias("fragment"),
    )


def _with(value: Column, make) -> Column:
    """make(value), with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def origin(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(F.lit("")))


def _sorted_query(query: Column) -> Column:
    """Parameters stable-sorted by name, written as a form is."""
    pairs = F.filter(F.split(F.substring(query, 2, 1_000_000), "&"), lambda x: x != "")
    whole = F.transform(pairs, lambda x: F.replace(F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("="))), F.lit("%20"), F.lit("+")))
    keyed = F.transform(whole, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("name"), i.alias("place"), x.alias("pair")))
    joined = F.array_join(F.transform(F.sort_array(keyed), lambda x: x["pair"]), "&")
    return F.when((query == "") | (joined == ""), F.lit("")).otherwise(F.concat(F.lit("?"), joined))


def normalize_url(url: Column) -> Column:
    """Without fragment, parameters sorted, one trailing slash dropped; invalid URLs stay as they are."""

    def make(p: Column) -> Column:
        query = _sorted_query(p["query"])
        user = F.when(p["user"] != "", F.concat(p["user"], F.lit("@"))).otherwise(F.lit(""))
        whole = F.concat(p["scheme"], F.lit("://"), user, F.substring_index(origin(p), "://", -1), F.regexp_replace(p["path"], "/$", ""), query)
        return F.when(~p["ok"], url).when(p["path"] == "/", F.concat(origin(p), query)).otherwise(whole)

    return _with(parts(url), make)


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^\s*https?://(?:[^/?#@\s]*@)?[^/?#:@\s]+"), F.lit(False))


def to_absolute_url(base: Column, relative: Column) -> Column:
    """``relative`` resolved against ``base``; absolute ones, ones with blanks and ones that can't be resolved stay."""

    def make(p: Column) -> Column:
        folder = F.regexp_replace(p["path"], "[^/]*$", "")
        mark = F.regexp_extract(relative, r"^([^?#]*)(.*)$", 2)
        own = F.regexp_extract(relative, r"^([^?#]*)(.*)$", 1)
        return (
            F.when(is_valid_url(relative) | F.contains(relative, F.lit(" ")) | ~p["ok"] | relative.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), relative)
            .when(F.startswith(relative, F.lit("//")), F.concat(p["scheme"], F.lit(":"), relative))
            .when(F.startswith(relative, F.lit("/")), F.concat(origin(p), resolved(own), mark))
            .when(relative == "", F.concat(origin(p), p["path"], p["query"]))
            .when(F.startswith(relative, F.lit("?")), F.concat(origin(p), p["path"], relative))
            .when(F.startswith(relative, F.lit("#")), F.concat(origin(p), p["path"], p["query"], relative))
            .otherwise(F.concat(origin(p), resolved(F.concat(folder, own)), mark))
        )

    return _with(parts(base), make)


def host(url: Column) -> Column:
    """Lower-cased host, null if the URL is invalid."""
    found = F.lower(F.regexp_extract(url, _URL, 3))
    return F.when(found != "", found)


def is_same_domain(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def extract_domain_name(url: Column) -> Column:
    """A short name for the site: from the path around ``documentation`` or ``docs``, else from the host."""

    def make(p: Column) -> Column:
        s = _segments(p["path"])
        after, docs = F.array_position(s, "documentation"), F.array_position(s, "docs")
        bare = F.regexp_replace(F.regexp_replace(p["host"], r"^(www\.|docs\.|api\.|developer\.|developers\.)", ""), r"\.(com|org|io|dev|net|edu)$", "")
        return (
            F.when(~p["ok"], F.lit("unknown"))
            .when((after > 0) & (after < F.size(s)), F.try_element_at(s, (after + 1).cast("int")))
            .when((docs > 1) & (F.size(s) > 1), F.try_element_at(s, (docs - 1).cast("int")))
            .otherwise(bare)
        )

    return _with(parts(url), make)


def url_to_filename(url: Column) -> Column:
    def make(p: Column) -> Column:
        flat = F.replace(F.regexp_replace(F.regexp_replace(p["path"], "^/", ""), "/$", ""), F.lit("/"), F.lit("_"))
        safe = F.regexp_replace(F.when(flat == "", F.lit("index")).otherwise(flat), r"[^a-zA-Z0-9._\-]", "_")
        return F.when(~p["ok"], F.lit("unknown.md")).when(F.endswith(safe, F.lit(".md")), safe).otherwise(F.concat(safe, F.lit(".md")))

    return _with(parts(url), make)


def glob_pattern(globs: list[str]) -> str:
    """One anchored expression for a list of globs: ``*`` any run, ``?`` one character."""
    each = ["".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g) for g in globs]
    return "^(?:" + "|".join(each) + r")\z" if each else r"\z\A."


def matches_patterns(url: Column, globs: list[str]) -> Column:
    return F.coalesce(url.rlike(glob_pattern(globs)), F.lit(False))


def site_key(url: Column) -> Column:
    """The last two labels of the host: URLs that discovery takes for one site share it, so it is an equi-join key."""
    return F.substring_index(host(url), ".", -2)


def is_url_match(a: Column, b: Column) -> Column:
    """Equal URL, host or last two host labels."""
    return F.coalesce(site_key(a) == site_key(b), F.lit(False))


def cheatsheet_path(url: Column, category: Column, base: str = "docs", suffix: str = "-Cheatsheet.md", day: Column | None = None) -> Column:
    """Where the cheat sheet of a URL is stored; invalid URLs get a dated file under ``tools``."""

    def make(p: Column) -> Column:
        bare = F.regexp_replace(p["host"], r"^(www\.|docs\.|api\.|developers?\.|help\.|support\.|learn\.)", "")
        tool = F.when(F.contains(p["host"], F.lit("github.com")), F.lit("github")).otherwise(F.substring_index(bare, ".", 1))
        clean = lambda c, keep: F.lower(F.regexp_replace(F.regexp_replace(c, f"[^a-zA-Z0-9{keep}-]", "-"), "-+", "-"))
        tool = clean(tool, "")
        deeper = F.transform(F.filter(_segments(p["path"]), lambda s: ~s.isin("docs", "api")), lambda s: clean(s, "."))
        today = F.date_format(day if day is not None else F.current_date(), "yyyy-MM-dd")
        where = F.array_join(F.concat(F.array(F.lit(base), category, tool), deeper, F.array(F.concat(tool, F.lit(suffix)))), "/")
        return F.when(p["ok"], where).otherwise(F.concat(F.lit(f"{base}/tools/cheatsheet-"), today, F.lit(".md")))

    return _with(parts(url), make)
