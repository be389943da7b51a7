"""Byte-level BPE: encoding and decoding of whole texts with a public vocabulary file.

Merging uses a segment tree over the ranks of adjacent pairs.  A leaf holds
``rank * leaves + position`` of the pair that begins there, a node the smaller of
its children, so the root is the lowest rank and, among equals, the leftmost
pair.  A merge changes three leaves (the merged pair, the swallowed one, the left
neighbour); each update climbs to the root in log(length) steps.  It ends when
the root holds no pair.

The trees of many pieces of one size class are rows of one numpy array and take
their steps together; a piece of any length works (a 1 MB word is one tree).

Texts are cut at single blanks first: a pretoken never reaches over a blank that
stands between other characters, so ids are cached per blank-separated segment.
Texts with longer white space go through the full pretoken pattern.  Caches are
bounded; they change speed only.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 400_000  # entries of each of the two caches of a worker
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_WHITE = {c for c in map(chr, range(0x3001)) if regex.fullmatch(f"[{WHITE}]", c)}
_NONE = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's token strings."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        chars = byte_characters()
        self.byte_id = np.array([ids[c] for c in chars], np.int64)
        back = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (max(max(ids.values()), *self.special.values()) + 1)
        for token, i in ids.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_keys, self.pair_ranks = key[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a huge number for pairs that don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)


class _Trees:
    """Segment trees of ``len(words)`` byte strings of at most ``leaves`` bytes, one per row."""

    def __init__(self, vocab: Vocabulary, words: list[bytes], leaves: int):
        n, self.vocab, self.leaves = len(words), vocab, leaves
        size = np.fromiter(map(len, words), np.int64, n)
        self.alive = np.arange(leaves) < size[:, None]
        self.token = np.zeros((n, leaves), np.int64)
        self.token[self.alive] = vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        self.next = np.tile(np.arange(1, leaves + 1), (n, 1))
        self.next[np.arange(n), size - 1] = leaves  # none
        self.prev = np.tile(np.arange(-1, leaves - 1), (n, 1))
        self.tree = np.full((n, 2 * leaves), _NONE)
        row, at = np.nonzero(self.alive[:, 1:])
        self.tree[row, leaves + at] = self._key(self.token[row, at], self.token[row, at + 1], at)
        level = leaves
        while level > 1:
            self.tree[:, level // 2 : level] = np.minimum(self.tree[:, level : 2 * level : 2], self.tree[:, level + 1 : 2 * level : 2])
            level //= 2

    def _key(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = self.vocab.ranks(left, right)
        return np.where(rank == _NONE, _NONE, rank * self.leaves + at)

    def _update(self, row: np.ndarray, leaf: np.ndarray, key: np.ndarray | int) -> None:
        node = leaf + self.leaves
        self.tree[row, node] = key
        while self.leaves > 1 and len(node) and node[0] > 1:
            node = node >> 1
            self.tree[row, node] = np.minimum(self.tree[row, 2 * node], self.tree[row, 2 * node + 1])

    def merge(self) -> None:
        row = np.arange(len(self.tree))
        root = self.tree[:, 1]
        while True:
            row = row[root[row] != _NONE]
            if not len(row):
                return
            at, token = root[row] % self.leaves, self.vocab.merged[root[row] // self.leaves]
            gone = self.next[row, at]
            after = self.next[row, gone]
            self.token[row, at], self.next[row, at], self.alive[row, gone] = token, after, False
            self._update(row, gone, _NONE)
            has = after < self.leaves
            key = np.full(len(row), _NONE)
            key[has] = self._key(token[has], self.token[row[has], after[has]], at[has])
            self.prev[row[has], after[has]] = at[has]
            self._update(row, at, key)
            before = self.prev[row, at]
            has = before >= 0
            b = before[has]
            self._update(row[has], b, self._key(self.token[row[has], b], token[has], b))

    def ids(self) -> list[bytes]:
        data = self.token[self.alive].astype("<u4").tobytes()
        ends = np.cumsum(self.alive.sum(1)) * 4
        return [data[s:e] for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


class Encoder:
    """Ids as little-endian unsigned 32-bit integers in one bytes object per text.

    ``library``: texts that no cache holds are given to a tokenizer library instead
    of the segment trees; the ids are the same.
    """

    def __init__(self, path: str, cache: int = CACHE, library: bool = False):
        self.vocab, self.cache = Vocabulary(path), cache
        self.library = self._library() if library else None
        self.segments: dict[str, bytes | None] = {}  # None: the segment's white space may belong to a longer run
        self.pretokens: dict[bytes, bytes] = {}

    def _library(self):
        if np.any(np.diff(self.vocab.merged) <= 0):
            return None  # ids don't follow the merges, as that library needs them to
        ranks = {b: i for i, b in enumerate(self.vocab.token_bytes) if i not in self.vocab.special.values()}
        return tiktoken.Encoding("pieces", pat_str=_PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def merge_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of byte strings that are one pretoken each, by size class."""
        classes: dict[int, list[bytes]] = {}
        for w in words:
            classes.setdefault(max(1, 1 << (len(w) - 1).bit_length()), []).append(w)
        out: dict[bytes, bytes] = {}
        for leaves, ws in classes.items():
            step = max(1, (1 << 18) // leaves)
            for i in range(0, len(ws), step):
                part = ws[i : i + step]
                trees = _Trees(self.vocab, part, leaves)
                trees.merge()
                out.update(zip(part, trees.ids(), strict=True))
        return out

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by their pretokens."""
        if self.library:
            return [array("I", self.library(t)).tobytes() for t in texts]
        cut = [[p.encode() for p in _PRETOKEN.findall(t)] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.pretokens)
        if len(self.pretokens) + len(new) > self.cache:
            self.pretokens.clear()
            new = set(chain.from_iterable(cut))
        self.pretokens.update(self.merge_words(new))
        get = self.pretokens.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        cut = [t.split(" ") for t in texts]
        new = list(set(chain.from_iterable(c[1:] for c in cut)).difference(self.segments))
        if len(self.segments) + len(new) > self.cache:
            self.segments.clear()
            new = list(set(chain.from_iterable(c[1:] for c in cut)))
        odd = {s for s in new if not s or s[0] in _WHITE or s[-1] in _WHITE}
        self.segments.update(dict.fromkeys(odd))
        regular = [s for s in new if s not in odd]
        self.segments.update(zip(regular, self._pieces([" " + s for s in regular]), strict=True))
        get = self.segments.__getitem__
        out: list[bytes | None] = []
        for c in cut:
            try:
                out.append(b"".join(map(get, c[1:])))
            except TypeError:
                out.append(None)
        # A text's first segment has no blank before it; white space at its end may belong to a longer run.
        heads = [c[0] for c in cut]
        whole = [i for i, (h, o) in enumerate(zip(heads, out, strict=True)) if o is None or len(cut[i]) > 1 and (not h or h[-1] in _WHITE)]
        for i in whole:
            heads[i] = texts[i]
        for i, ids in enumerate(self._pieces(heads)):
            out[i] = ids + (out[i] if heads[i] is not texts[i] else b"")
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.vocab.splitter or not any(s in t for s in self.vocab.special for t in texts):
            return self._plain(texts)
        parts = [self.vocab.splitter.split(t) for t in texts]
        plain = iter(self._plain([x for p in parts for x in p[0::2]]))
        special = {k: np.array([v], "<u4").tobytes() for k, v in self.vocab.special.items()}
        return [b"".join(special[x] if k % 2 else next(plain) for k, x in enumerate(p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.vocab.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str, library: bool = False) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, library=library)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows with their texts (null: empty), cut so that a chunk holds about ``most`` characters."""
    for b in batches:
        texts = [x if x is not None else "" for x in b.column(column).to_pylist()]
        at, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > most:
                yield b.slice(at, i - at), texts[at:i]
                at, held = i, 0
            held += len(t)
        if at < len(texts):
            yield b.slice(at), texts[at:]


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded (text of those ids).

    ``tokenizer`` is the path of a byte-level BPE file that every worker can read.
    Null text counts as empty: no ids, empty decoded text.  A null id stays null,
    repeated rows each get a row, other columns are not read, an empty table gives
    no rows.  A text's size is bounded only by one worker's memory.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        enc = encoder(tokenizer)
        for b, texts in text_chunks(batches):
            ids = enc.encode(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), binary_array(ids), pa.array([enc.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")
