"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is both input and reference.  The reference is cut, by content,
into *blocks*: the word run around one anchor.  The anchor of a window of
``width`` words is the smallest hash of its ``GRAM``-word grams, so equal windows
have equal anchors wherever they stand; consecutive windows with one anchor form
a block.  All blocks of all documents are indexed:

* block index: (anchor, hash of the block's words) -> first occurrence, the smallest
  (document id, word position);
* window index, for anchors that stand in several different blocks: hash of the
  window's words -> first occurrence.

A document is then factored from left to right.  A factor (start, length, reference
document, reference position) begins at the first word not yet tried whose window
occurs in a smaller document, and greedily grows by one word after another while
that same reference goes on; blocks that match as a whole let it grow over all
their windows at once.  Where the reference changes or the next block does not match as a
whole the factor ends, and there, at the factor's boundary, the windows that straddle it
are checked one by one and begin factors of their own.  A factor is at least
``width`` words long and its words are duplicates.  Anchors that no other document
has cannot start a factor, so those blocks are never looked at again; this loses
nothing.

Scale: only hashes are shuffled for the index (a block is about twenty words);
both indexes are minima, combined on the map side, so a passage that a third of
the documents hold is one row per map task, and the first occurrences of hot passages
are broadcast (``spread_join``) when they go back to the documents.

Identity: a block is known by 128 bits (anchor and block hash), a window by 128 in the index;
within one document its references are found by 64.

Defined results: null text and texts without words give n_words 0 and an empty
kept text; texts shorter than ``width`` words are kept whole; a null id counts as
the largest; rows that repeat an id are each factored, and never against each
other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import spread_join, written
from docquarry.llm.words import BASE_A, BASE_B, U, as_bytes, hash_words, mix, sliding_min, span_hashes, window_hashes

GRAM = 8
_NO_ID = 2**63 - 1


def _blocks(words: np.ndarray, offsets: np.ndarray, width: int):
    """Anchor, first and last window and owner of every block of a batch."""
    grams = window_hashes(words, GRAM)
    least = sliding_min(grams, width - GRAM + 1)  # by window; those over a border of texts are left out
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    anchor = least[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first, len(window))[1:] - 1
    return anchor[first], window[first] if len(first) else first, window[last] if len(first) else last, owner[first]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.cumsum([len(x) if x is not None else 0 for x in b.column(column).cast(pa.binary()).to_pylist()])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def _emit_blocks(width: int):
    def run(batches):
        for b in _pieces(batches):
            words, offsets = hash_words(as_bytes(b.column("text")))
            anchor, first, last, owner = _blocks(words, offsets, width)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)[owner]
            block = span_hashes(words, first, last + width)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(anchor)), pa.array(_signed(block)), pa.array(ids), pa.array(first - offsets[owner])], ["anchor", "block", "doc_id", "pos"])

    return run


def _emit_windows(width: int):
    """The windows of those blocks that hold a new variant of a shared anchor."""

    def run(batches):
        for b in _pieces(batches):
            words, offsets = hash_words(as_bytes(b.column("text")))
            _, first, last, owner = _blocks(words, offsets, width)
            asked = _find(b.column("variants"), owner, _signed(span_hashes(words, first, last + width)))[1]
            first, last, owner = first[asked], last[asked], owner[asked]
            n = last - first + 1
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owner = np.repeat(owner, n)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)[owner]
            a, c = _two_hashes(words, at, width)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(ids), pa.array(at - offsets[owner])], ["a", "b", "doc_id", "pos"])

    return run


def _two_hashes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_signed(window_hashes(words, width, base)[at]) if len(at) else np.empty(0, np.int64) for base in (BASE_A, BASE_B))


def _find(lists: pa.Array, owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every (owner, value): the place of that value among the owner's list, counted over all lists, and whether it is there.

    The lists hold the values, or structs that begin with them.
    """
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    held = lists.flatten()
    held = (held.field(0) if pa.types.is_struct(held.type) else held).to_numpy(zero_copy_only=False).astype(np.int64)
    tag = lambda o, v: v.view(U) ^ mix(o.astype(U) + U(1))
    tags = tag(np.repeat(np.arange(len(sizes)), sizes), held)
    order = np.argsort(tags)
    if not len(order) or not len(value):
        return np.zeros(len(value), np.int64), np.zeros(len(value), bool)
    asked = tag(owner, value)
    at = np.minimum(np.searchsorted(tags[order], asked), len(order) - 1)
    return order[at], tags[order[at]] == asked


def _references(lists: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and position of the references at ``places`` of lists of (value, document, position)."""
    held = lists.flatten()
    return tuple(held.field(k).to_numpy(zero_copy_only=False)[places] if len(places) else np.empty(0, np.int64) for k in (1, 2))


def parse(start: np.ndarray, doc: np.ndarray, pos: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of covered windows in order: places of each factor's first window, and its words.

    A factor grows while the next window is the next word's and its reference is the same document's next word.
    """
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(start))) + width - 1


def _factor(width: int):
    """Greedy factors of every document, the spans of words they remove, and what is left."""

    def run(batches):
        for b in _pieces(batches):
            texts = as_bytes(b.column("text"))
            words, offsets = hash_words(texts)
            _, first, last, owner = _blocks(words, offsets, width)
            block = _signed(span_hashes(words, first, last + width))
            place, whole = _find(b.column("matched"), owner, block)
            part = _find(b.column("variants"), owner, block)[1] & ~whole
            n = (last - first + 1)[whole]  # windows of matched blocks: the block's reference, and on
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, pos = _references(b.column("matched"), place[whole])
            hits = [(np.repeat(first[whole], n) + inside, np.repeat(doc, n), np.repeat(pos, n) + inside, np.repeat(owner[whole], n))]
            n = (last - first + 1)[part]  # single windows at the boundaries
            at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            place, there = _find(b.column("windows"), np.repeat(owner[part], n), _two_hashes(words, at, width)[0])
            hits.append((at[there], *_references(b.column("windows"), place[there]), np.repeat(owner[part], n)[there]))
            start, doc, pos, own = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.argsort(start, kind="stable")
            start, doc, pos, own = start[order], doc[order], pos[order], own[order]
            begin, length = parse(start, doc, pos, own, width)
            cover = np.zeros(len(words) + 1, np.int64)  # +1 where a factor begins, -1 behind its end
            np.add.at(cover, start[begin], 1)
            np.add.at(cover, start[begin] + length, -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept, spans, removed = [], [], []
            for i, text in enumerate(texts):
                mine = gone[offsets[i] : offsets[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[0::2], edges[1::2], strict=True)])
                removed.append(int(mine.sum()))
                words_of, at, left = text.split(), 0, []
                for s in spans[-1]:
                    left += words_of[at : s["start"]]
                    at = s["end"]
                kept.append(b" ".join(left + words_of[at:] if at else words_of).decode())
            fields = [start[begin] - offsets[own[begin]], length, doc[begin], pos[begin]]
            ends = np.searchsorted(own[begin], np.arange(len(texts) + 1)).astype(np.int32)
            factors = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in fields], ["start", "length", "ref_id", "ref_start"]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), factors, pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "factors", "kept_text"],
            )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word ranges), factors, kept_text; one row per input row."""
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    blocks = written(rows.mapInArrow(_emit_blocks(width), "anchor long, block long, doc_id long, pos long"), "blocks", arrow_rows=2000)
    occurrence, rows_of = F.min(F.struct("doc_id", "pos")).alias("ref"), F.count(F.lit(1)).alias("rows")
    shared = (
        blocks.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("block") != F.max("block")).alias("varied"), rows_of)
        .filter("lo < hi")
        .select("anchor", "varied", "rows")
    )
    candidates = written(spread_join(blocks, written(shared, "anchors"), ["anchor"]), "candidates")
    index = written(candidates.groupBy("anchor", "block").agg(occurrence, rows_of), "index")
    known = spread_join(candidates.select("anchor", "block", "doc_id", "varied"), index, ["anchor", "block"]).filter("ref.doc_id < doc_id OR varied")
    facts = known.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("ref.doc_id") < F.col("doc_id"), F.struct("block", "ref.doc_id", "ref.pos"))).alias("matched"),
        F.collect_set(F.when(F.col("ref.doc_id") == F.col("doc_id"), F.col("block"))).alias("variants"),
    )
    facts = written(facts, "block-facts")

    asked = rows.join(facts.filter("size(variants) > 0").select("doc_id", "variants"), "doc_id")
    windows = written(asked.mapInArrow(_emit_windows(width), "a long, b long, doc_id long, pos long"), "windows")
    earliest = windows.groupBy("a", "b").agg(occurrence, F.max("doc_id").alias("last_id"), rows_of).filter("ref.doc_id < last_id").drop("last_id")
    repeated = spread_join(windows.drop("pos"), written(earliest, "window-index"), ["a", "b"]).filter("ref.doc_id < doc_id")
    repeated = repeated.groupBy("doc_id").agg(F.collect_set(F.struct("a", "ref.doc_id", "ref.pos")).alias("windows"))

    empty = lambda c: F.array().cast(f"array<{c}>")
    reference = "struct<block:bigint,doc_id:bigint,pos:bigint>"
    filled = [F.coalesce("matched", empty(reference)).alias("matched"), F.coalesce("variants", empty("bigint")).alias("variants"), F.coalesce("windows", empty(reference.replace("block", "a"))).alias("windows")]
    joined = rows.join(facts, "doc_id", "left").join(repeated, "doc_id", "left").select("doc_id", "text", *filled)
    out = joined.mapInArrow(
        _factor(width),
        "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, factors array<struct<start:long,length:long,ref_id:long,ref_start:long>>, kept_text string",
    )
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
