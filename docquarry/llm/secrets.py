"""Secret scans with a trigram inverted index.

For each rule a Boolean query over trigrams is derived from the parsed regular
expression: every match must contain them.  Documents are taken in blocks; a
block's postings (trigram -> documents) are built for the trigrams that any query
names, the queries are evaluated on them by intersection and union, and only the
candidates are verified with the expression.  Rules without mandatory trigrams
scan every document.

Postings are per block, so the index is never shuffled and a lost executor costs
its blocks only.  All work is on UTF-8 bytes; offsets are returned in code points.

Defined results: null text counts as empty; repeated rows each get a row; a null
id stays null; columns that are not named are not read (``redact_secrets`` keeps
them as they are).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.substring_dedup import _pieces
from docquarry.llm.words import as_bytes

try:  # the standard library's own expression parser
    from re import _constants as C
    from re import _parser as P
except ImportError:  # Python before 3.11
    import sre_constants as C
    import sre_parse as P

MOST_LITERALS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    least: int = 0  # code points of ...
    group: int = 0  # ... this group


#: The first three are the base kinds; the others are published credential formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", False, 20),
    Rule("hex", r"[0-9a-f]{24,}", False, 24),  # the runs of [0-9a-f]+ that are long enough
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{20,}"),
    Rule("url_login", r"[a-z]{2,12}://[^/\s:@]{1,64}:[^/\s:@]{1,64}@"),
)
BASE = tuple(r.kind for r in RULES[:3])

# A query is True (no condition), a trigram (bytes), or ("and" | "or", frozenset of queries).


def _and(parts) -> object:
    parts = {p for p in parts if p is not True}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _or(parts) -> object:
    parts = set(parts)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _of_literals(literals: set[bytes]) -> object:
    return _or(_and(s[i : i + 3] for i in range(len(s) - 2)) for s in literals)


def _join(left: set[bytes], right: set[bytes]) -> set[bytes] | None:
    return {a + b for a in left for b in right} if len(left) * len(right) <= MOST_LITERALS else None


def _sequence(nodes, fold: Callable[[int], bytes]) -> tuple[set[bytes] | None, object]:
    """(all strings the sequence can be, if few; what every match must contain)."""
    run, exact, musts = {b""}, True, []

    def end_run():
        nonlocal run, exact
        musts.append(_of_literals(run))
        run, exact = {b""}, False

    for node in nodes:
        strings, must, broken = _node(node, fold)
        longer = _join(run, strings) if strings is not None else None
        if longer is None:
            end_run()
            musts.append(must)
            if strings is not None:
                run = strings
        else:
            run = longer
        if broken:
            end_run()
    return (run if exact else None), _and([*musts, _of_literals(run)])


def _node(node, fold) -> tuple[set[bytes] | None, object, bool]:
    """(strings, must, whether more of the same may follow)."""
    op, arg = node
    if op is C.LITERAL and arg < 128:
        return {fold(arg)}, True, False
    if op is C.IN:
        chars = _class(arg)
        return ({fold(c) for c in chars} if chars else None), True, False
    if op is C.SUBPATTERN:
        return (*_sequence(arg[-1], fold), False)
    if op is C.BRANCH:
        found = [_sequence(b, fold) for b in arg[1]]
        strings = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
        return (strings if strings is not None and len(strings) <= MOST_LITERALS else None), _or(m for _, m in found), False
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, must = _sequence(inner, fold)
        if least == 0:
            return (strings | {b""} if strings is not None and most == 1 else None), True, False
        if strings is None:
            return None, must, False
        out: set[bytes] | None = {b""}
        for _ in range(min(least, 8)):
            out = _join(out, strings) if out is not None else None
        return out, must, out is not None and (most != least or least > 8)
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {b""}, True, False
    return None, True, False


def _class(items) -> list[int] | None:
    """Members of a small ASCII class."""
    out: list[int] = []
    for op, arg in items:
        if op is C.LITERAL:
            out.append(arg)
        elif op is C.RANGE and arg[1] - arg[0] < 6:
            out += range(arg[0], arg[1] + 1)
        else:
            return None
    return out if len(out) <= 6 and all(c < 128 for c in out) else None


def trigram_query(pattern: str) -> object:
    """What every match of ``pattern`` must contain, in lower case (the index folds case)."""
    return _sequence(P.parse(pattern), lambda c: bytes([c]).lower())[1]


def trigrams(query: object) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.expressions = [re.compile(r.pattern.encode(), re.IGNORECASE if r.ignore_case else 0) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.terms = sorted(set().union(*map(trigrams, self.queries)))
        if len(self.terms) > 254:
            raise ValueError("too many trigrams")
        self.number = np.zeros(1 << 24, np.uint8)  # trigram -> 1 + its place in terms
        for i, t in enumerate(self.terms):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def candidates(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each rule, which documents of the block can match."""
        a = np.frombuffer(b"\n".join(texts).lower() + b"\n\n\n", np.uint8)
        code = a[:-2].astype(np.int32) << 8
        code |= a[1:-1]
        code <<= 8
        code |= a[2:]
        number = self.number[code]
        at = np.flatnonzero(number)
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, at, "right")
        postings = np.zeros((len(self.terms) + 1, len(texts)), bool)
        postings[number[at][doc < len(texts)], doc[doc < len(texts)]] = True
        place = {t: i + 1 for i, t in enumerate(self.terms)}

        def evaluate(q) -> np.ndarray:
            if q is True:
                return np.ones(len(texts), bool)
            if isinstance(q, bytes):
                return postings[place[q]]
            parts = [evaluate(x) for x in q[1]]
            return np.logical_and.reduce(parts) if q[0] == "and" else np.logical_or.reduce(parts)

        return [evaluate(q) for q in self.queries]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in bytes of every finding, ordered, for each document."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, expression, ok) in enumerate(zip(self.rules, self.expressions, self.candidates(texts), strict=True)):
            for i in np.flatnonzero(ok).tolist():
                for m in expression.finditer(texts[i]):
                    if len(m[rule.group]) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in out]


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _points(text: bytes, at: list[int]) -> list[int]:
    """Byte offsets as code point offsets."""
    if text.isascii():
        return at
    first = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(first[x - 1]) if x else 0 for x in at]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end in code points; by start, then by the order of the rules)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        scanner = _scanner(rules)
        for b in _pieces(batches):
            texts = as_bytes(b.column("text"))
            spans = []
            for text, found in zip(texts, scanner.spans(texts), strict=True):
                starts, ends = _points(text, [s for s, _, _ in found]), _points(text, [e for _, _, e in found])
                spans.append([{"kind": rules[k].kind, "start": s, "end": e} for (_, k, _), s, e in zip(found, starts, ends, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _redacted(text: bytes, spans: list[tuple[int, int, int]], mark: bytes) -> bytes:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return b"".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every finding in ``text_col`` replaced by ``mark`` (overlapping ones by one); nulls stay null."""

    def run(batches):
        scanner = _scanner(rules)
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for b in _pieces(iter([whole]), text_col):
                texts = as_bytes(b.column(at))
                done = [_redacted(t, s, mark.encode()) if s else t for t, s in zip(texts, scanner.spans(texts), strict=True)]
                new = pa.array(done, pa.binary()).cast(pa.string())
                null = b.column(at).is_null()
                columns = [b.column(i) for i in range(b.num_columns)]
                columns[at] = pa.compute.if_else(null, pa.scalar(None, pa.string()), new)
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
