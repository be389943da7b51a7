"""A small HTML tree and its Markdown, on the standard library alone.

Covers what documentation pages use: void elements, raw text, implied ends of
``p``, ``li``, table parts and options, stray and missing end tags.  Anything left
open at the end is closed there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

# Selectors.
NOISE_TAGS = {"nav", "header", "footer", "aside", "script", "style", "noscript"}
NOISE_CLASSES = {
    "navigation", "nav", "sidebar", "menu", "breadcrumb", "breadcrumbs", "toc", "table-of-contents", "ads", "advertisement", "social", "share", "comment", "comments", "related", "suggestions",
}
CONTENT = ("main", "article", ".content", ".docs-content", ".markdown-body", "#content")
ALERTS = ("alert", "callout", "note", "warning", "info")
ICONS = (("warning", "> ⚠️"), ("info", "> ℹ️"), ("note", "> 📝"))

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "details", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
_WALLS = {"table", "ul", "ol", "dl", "body", "html"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def inner(self) -> str:
        return "".join(escape(c, quote=False) if isinstance(c, str) else c.outer() for c in self.children)

    def outer(self) -> str:
        attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{self.inner()}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags: set[str], walls: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in walls:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close({"p"}, _WALLS | {"div", "section", "article", "main", "li", "blockquote", "td", "th"})
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _WALLS - {tag})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            while self.open[-1].tag != tag:
                self.open.pop()
            self.open.pop()

    def handle_data(self, data):
        self.open[-1].children.append(data)


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def _literal(m: re.Match) -> str:
    """A reference as it is if it is a known one with its semicolon, else with its ampersand as text."""
    return m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}"


def parse(html: str, closed: bool = False) -> Node:
    """The tree of a page. ``closed``: only references with their semicolon are read, where HTML also takes ``&amp`` for one."""
    builder = _Builder()
    builder.feed(_REFERENCE.sub(_literal, html) if closed else html)
    builder.close()
    return builder.root


def select(root: Node, selector: str):
    for n in root.walk():
        if selector[0] == "." and selector[1:] in n.classes or selector[0] == "#" and n.attrs.get("id") == selector[1:] or n.tag == selector:
            yield n


def title(root: Node) -> str:
    first = next(select(root, "h1"), None)
    found = first.text().strip() if first else ""
    found = found or "".join(n.text() for n in select(root, "title")).strip()
    if not found:
        named = next((n for n in root.walk() if {"page-title", "title", "heading"} & set(n.classes)), None)
        found = named.text().strip() if named else ""
    return re.sub(r"(?:\\s)+", " ", found.replace("\\n", " ")).strip() or "Untitled"


def links(root: Node, base: str) -> list[str]:
    """Absolute targets in document order, each once; fragments, scripts and unusable ones are left out."""
    out = []
    for a in select(root, "a"):
        href = a.attrs.get("href", "").strip()
        if not href or href.startswith("#") or href.lower().startswith("javascript:"):
            continue
        try:
            to = urljoin(base, href)
            parts = urlsplit(to)
        except ValueError:
            continue
        if parts.scheme in ("http", "https"):
            if not parts.netloc:
                continue
            if not parts.path:
                to = parts._replace(path="/").geturl()
        elif not parts.scheme:
            continue
        if not to.startswith("javascript:"):
            out.append(to)
    return list(dict.fromkeys(out))


def without_noise(node: Node) -> Node:
    node.children = [c for c in node.children if isinstance(c, str) or c.tag not in NOISE_TAGS and not NOISE_CLASSES & set(c.classes)]
    for c in node.children:
        if isinstance(c, Node):
            without_noise(c)
    return node


def content(root: Node) -> Node:
    """The main part of a cleaned page, or its body where that part is empty."""
    for selector in CONTENT:
        found = next(select(root, selector), None)
        if found:
            if found.children:
                return found
            break
    return next(select(root, "body"), root)


# ---------------------------------------------------------------- Markdown


def _block(text: str) -> str:
    return f"\n\n{text}\n\n"


def _escape(text: str) -> str:
    text = re.sub(r"([\\*_\[\]`])", r"\\\1", text)
    return re.sub(r"^(\d+)\. ", r"\1\\. ", re.sub(r"^([+\-]|#{1,6}|=+|~~~|>)(?=\s|$)", r"\\\1", text))


def _children(node: Node, depth: int) -> str:
    out = ""
    for c in node.children:
        if isinstance(c, str):
            piece = re.sub(r"[ \t\r\n]+", " ", c)
            if node.tag in ("ul", "ol", "table", "tr") and not piece.strip():
                continue
            piece = _escape(piece)
            if not out or out[-1] in " \n":
                piece = piece.lstrip(" ")
        else:
            piece = _markdown(c, depth)
        if piece.startswith("\n"):  # blocks keep two line feeds between them
            body = piece.lstrip("\n")
            gap = max(len(piece) - len(body), len(out) - len(out.rstrip("\n")))
            out = out.rstrip(" \n") + "\n" * min(gap, 2) + body
        else:
            out += piece
    return out


def _wrapped(inner: str, mark: str) -> str:
    core = inner.strip()
    if not core:
        return inner
    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def _list(node: Node, depth: int) -> str:
    number = int(node.attrs["start"]) if node.attrs.get("start", "").lstrip("-").isdigit() else 1
    items = []
    for c in node.children:
        if not isinstance(c, Node):
            continue
        mark = "-   " if node.tag == "ul" else f"{number}.  "
        number += 1
        body = _children(c, depth + 1).strip("\n ")
        items.append(mark + body.replace("\n", "\n    "))
    return "\n".join(items)


def _table(node: Node) -> str:
    rows = []
    for i, tr in enumerate(select(node, "tr")):
        cells = []
        for cell in (n for n in tr.walk() if n.tag in ("th", "td")):
            parts = [f"`{c.text()}`" if isinstance(c, Node) and c.tag == "code" else None if isinstance(c, Node) else escape(c, quote=False) for c in _flat(cell)]
            cells.append("".join(p for p in parts if p is not None).strip().replace("|", "\\|"))
        if cells:
            rows.append("| " + " | ".join(cells) + " |")
            if i == 0 and next(select(tr, "th"), None):
                rows.append("| " + " | ".join(["---"] * len(cells)) + " |")
    return _block("\n".join(rows)) if rows else ""


def _flat(node: Node):
    """Texts and code elements of a cell, in order."""
    for c in node.children:
        if isinstance(c, str) or c.tag == "code":
            yield c
        else:
            yield from _flat(c)


def _pre(node: Node) -> str:
    code = next(select(node, "code"), None)
    language = re.search(r"language-([a-zA-Z0-9-]+)", code.attrs.get("class", "")) if code else None
    return _block(f"```{language[1] if language else ''}\n{(code or node).text().strip()}\n```")


def _markdown(node: Node, depth: int = 0) -> str:
    tag = node.tag
    if tag == "pre":
        return _pre(node)
    if tag == "table":
        return _table(node)
    if tag == "div" and any(a in node.attrs.get("class", "") for a in ALERTS):
        prefix = next((icon for name, icon in ICONS if name in node.attrs["class"]), ">")
        return _block("\n".join(f"{prefix} {line.strip()}" for line in node.text().strip().split("\n")))
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return _block("* * *")
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})" if node.attrs.get("src") else ""
    if tag in ("ul", "ol"):
        body = _list(node, depth)
        return f"\n{body}\n" if depth else _block(body)
    if tag == "code":
        text = node.text()
        return f"`{text}`" if text else ""
    if tag in ("script", "style", "head", "title", "noscript", "template"):
        return ""
    inner = _children(node, depth)
    if not inner.strip() and tag not in ("a",):
        return ""
    if re.fullmatch("h[1-6]", tag):
        return _block("#" * int(tag[1]) + " " + re.sub(r"\s*\n\s*", " ", inner.strip()))
    if tag in ("strong", "b"):
        return _wrapped(inner, "**")
    if tag in ("em", "i"):
        return _wrapped(inner, "*")
    if tag == "a" and node.attrs.get("href"):
        named = f' "{node.attrs["title"]}"' if node.attrs.get("title") else ""
        return f"[{inner}]({node.attrs['href']}{named})"
    if tag == "blockquote":
        return _block("\n".join("> " + line if line else ">" for line in inner.strip("\n ").split("\n")))
    return _block(inner.strip("\n ")) if tag in BLOCK else inner


def to_markdown(node: Node) -> str:
    return _children(node, 0).strip()


def page(html: str | None, url: str | None, closed: bool = False) -> dict:
    """title, markdown, links and error of one page; never raises."""
    try:
        root = parse(html or "", closed)
        found = {"title": title(root), "links": links(root, url or "")}
        found["markdown"] = to_markdown(content(without_noise(root)))
        found["error"] = None if found["markdown"] else "No content extracted"
        return found
    except (RecursionError, ValueError, AssertionError) as e:
        return {"title": "Untitled", "links": [], "markdown": "", "error": f"{type(e).__name__}: {e}"[:200]}
