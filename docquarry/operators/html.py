"""Page extraction over tables: one Arrow pass gives title, Markdown, links and error of every page."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.htmltree import page

_FIELDS = "title string, markdown string, links array<string>, error string"


_PIECE = 1 << 20  # bytes of HTML at a time


def _pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = _PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of a string column, or of one row; freed memory is given back after each batch."""
    for b in batches:
        at = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
            if i > at and size + n > most:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < b.num_rows:
            yield b.slice(at)
        del b
        _give_back()


def _give_back() -> None:
    """Returns the memory that this process has freed to the system: a worker lives on beside later steps."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def parse_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, closed: bool = False) -> DataFrame:
    """(url, title, markdown, links, error) and the columns ``keep``; one row per input row, null html is an empty page.

    ``closed``: only character references with their semicolon are read.
    Beside the Arrow batch that it was given, a worker holds a piece of HTML and what was found there.
    """
    keep = keep or []

    def run(batches):
        for b in _pieces(batches, 1):
            found = [page(h, u, closed) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns = [b.column(0), *(pa.array([x[k] for x in found], pa.string()) for k in ("title", "markdown")), pa.array([x["links"] for x in found], pa.list_(pa.string())), pa.array([x["error"] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [b.column(c) for c in keep], ["url", "title", "markdown", "links", "error", *keep])

    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, "url string, " + _FIELDS + kept)


def raw_links(html: Column) -> Column:
    """array<string> of href values in document order, without fragments and scripts."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""), 1)
    return F.filter(found, lambda h: (h != "") & ~F.startswith(h, F.lit("#")) & ~F.startswith(h, F.lit("javascript:")))
