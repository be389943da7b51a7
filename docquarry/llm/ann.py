"""Maximum inner product search with score-aware anisotropic quantisation, and an exact check of what it leaves.

Product quantisation with 16 centroids for each group of ``group`` dimensions, so
a vector is four bits per group.  The loss is anisotropic: with r = x - q, the
part of r parallel to x counts ``eta`` times its orthogonal part, for it is the
parallel part that shifts large inner products.  The parallel part couples the
groups, so codes are found by coordinate descent over groups, and centroids by
the normal equations of that same loss.  Codebooks are fitted on a bounded sample
of ``fit_rows`` vectors; every vector is encoded.

Search: equal vectors share one code (their ids stay, as many as a result can
show).  Codes and queries are dealt into blocks; every block of queries meets
every block of codes once, a query's table of 16 entries per group is cut to
unsigned bytes and summed over the codes.  The first ``rerank`` by these sums are
scored exactly and give the score that a vector must reach.  A later vector is left
out only where its sum and the norm of what its code misses prove it too low
(Cauchy-Schwarz); all others are scored on their original components.  So the
result is exact on any rows, and codes only decide how much work it takes.

Scale: the pass over the codes is queries x rows, by design; where codes prove
little it is a product of matrices.  A block of codes carries its vectors, in single
precision where that loses nothing.  Blocks bound every task's memory, and about
``k`` rows per query leave it.  Nothing is broadcast but the codebooks.

Defined results: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; ids that are null take no part; of a query
id that repeats, the vector first in order asks; a repeated id is found once, with its
best score; vectors keep double precision; an empty table gives no rows; ties go to the
smaller id; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.shared import written

CENTROIDS = 16
CODE_BLOCK, QUERY_BLOCK, QUERY_BLOCKS = 4096, 256, 16
BLOCK_VALUES = 1 << 18  # components of a block of codes, at most
PAIRS = 1 << 16  # scored at a time


class Quantiser:
    """Codebooks [groups, 16, width] and the anisotropic loss."""

    def __init__(self, books: np.ndarray, dims: int, eta: float):
        self.books, self.dims, self.eta = books, dims, eta
        self.groups, _, self.width = books.shape

    def split(self, x: np.ndarray) -> np.ndarray:
        """[n, dims] to [n, groups, width], padded with zeros."""
        pad = self.groups * self.width - self.dims
        return np.pad(np.asarray(x, np.float64), ((0, 0), (0, pad))).reshape(len(x), self.groups, self.width)

    def encode(self, x: np.ndarray, passes: int = 3) -> np.ndarray:
        parts = self.split(x)
        unit = parts / np.linalg.norm(x.astype(np.float64), axis=1)[:, None, None]
        off = ((parts[:, :, None, :] - self.books[None]) ** 2).sum(3)  # [n, groups, 16]
        codes = off.argmin(2)
        along = np.einsum("ngw,ngcw->ngc", unit, parts[:, :, None, :] - self.books[None])
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(passes):
            for g in range(self.groups):
                rest = total - along[rows, g, codes[:, g]]
                codes[:, g] = (off[:, g] + (self.eta - 1) * (rest[:, None] + along[:, g]) ** 2).argmin(1)
                total = rest + along[rows, g, codes[:, g]]
        return codes.astype(np.uint8)

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Centroids that minimise the loss for these codes, one group after another."""
        parts = self.split(x)
        unit = parts / np.linalg.norm(x.astype(np.float64), axis=1)[:, None, None]
        chosen = np.stack([self.books[g][codes[:, g]] for g in range(self.groups)], 1)
        along = (unit * (parts - chosen)).sum(2)
        total = along.sum(1)
        for g in range(self.groups):
            u, p = unit[:, g], parts[:, g]
            rest = total - along[:, g]
            left = np.eye(self.width)[None] + (self.eta - 1) * u[:, :, None] * u[:, None, :]
            right = p + (self.eta - 1) * (rest + (u * p).sum(1))[:, None] * u
            for c in range(CENTROIDS):
                own = codes[:, g] == c
                if own.any():
                    self.books[g, c] = np.linalg.solve(left[own].sum(0), right[own].sum(0))
            along[:, g] = (u * (p - self.books[g][codes[:, g]])).sum(1)
            total = rest + along[:, g]


def train(sample: np.ndarray, group: int = 2, threshold: float = 0.2, rounds: int = 5, seed: int = 1) -> Quantiser:
    """Codebooks of a sample; ``threshold`` is the share of a vector's norm from which scores matter."""
    n, dims = sample.shape
    groups = -(-dims // group)
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    q = Quantiser(np.zeros((groups, CENTROIDS, group)), dims, eta)
    parts = q.split(sample)
    for g in range(groups):  # Lloyd's steps for a start
        points = parts[:, g]
        books = points[rng.choice(n, CENTROIDS, replace=n < CENTROIDS)].copy()
        for _ in range(10):
            own = ((points[:, None] - books[None]) ** 2).sum(2).argmin(1)
            for c in range(CENTROIDS):
                books[c] = points[own == c].mean(0) if (own == c).any() else points[rng.integers(n)]
        q.books[g] = books
    for _ in range(rounds):
        q.refit(sample, q.encode(sample, 1))
    return q


def byte_tables(q: Quantiser, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of queries with all centroids as unsigned bytes [n, groups, 16], and the size of one step."""
    tables = np.einsum("ngw,gcw->ngc", q.split(queries), q.books)
    tables -= tables.min(2, keepdims=True)
    step = np.maximum(tables.max((1, 2)) / 255, 1e-30)
    return np.round(tables / step[:, None, None]).astype(np.uint8), step


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums [queries, codes] of table entries; pairs of groups are looked up by one byte."""
    n, groups, _ = tables.shape
    if groups % 2:
        tables = np.concatenate([tables, np.zeros((n, 1, CENTROIDS), np.uint8)], 1)
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    pairs = (tables[:, 0::2, :, None].astype(np.uint16) + tables[:, 1::2, None, :]).reshape(n, -1, CENTROIDS * CENTROIDS)
    both = codes[:, 0::2] * CENTROIDS + codes[:, 1::2]
    out = np.zeros((n, len(codes)), np.uint16 if groups < 256 else np.uint32)
    for p in range(pairs.shape[1]):
        out += pairs[:, p].take(both[:, p], axis=1)
    return out


class _Best:
    """The vectors of the ``k`` + 1 best ids for each query of a block, over all codes met so far."""

    def __init__(self, q: Quantiser, ids: np.ndarray, vectors: np.ndarray, k: int, rerank: int):
        self.q, self.ids, self.vectors, self.k, self.rerank = q, ids, vectors, k, rerank
        self.tables, self.step = byte_tables(q, vectors)
        least = np.einsum("ngw,gcw->ngc", q.split(vectors), q.books).min(2).sum(1)
        self.base = least + self.step * q.groups  # a sum of bytes is off by half a step a group; the other half covers rounding
        self.norm = np.linalg.norm(vectors, axis=1)
        self.bar = np.full(len(ids), -np.inf)  # what a score must reach
        self.row, self.found, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def meet(self, ids: np.ndarray, codes: np.ndarray, x: np.ndarray) -> None:
        """Codes of vectors ``x``, both in order of ids."""
        with np.errstate(all="ignore"):  # what overflows proves nothing, so it is scored
            sums = scan(self.tables, codes)
            first = np.zeros(sums.shape, bool)
            m = min(self.rerank, len(ids))
            new = np.flatnonzero(np.isneginf(self.bar))
            best = np.argpartition(sums[new], len(ids) - m, axis=1)[:, len(ids) - m :]
            first[new[:, None], best] = True
            self._take(first, ids, x)
            missed = np.linalg.norm(x - np.concatenate([self.q.books[g][codes[:, g]] for g in range(self.q.groups)], 1)[:, : x.shape[1]], axis=1)
            length = np.linalg.norm(x, axis=1)
            most = self.step[:, None] * sums + self.base[:, None] + self.norm[:, None] * (missed + 1e-9 * (missed + length))
            open_ = ~(most < self.bar[:, None]) & ~first
            some = np.flatnonzero(open_.any(0))
            if not len(some):
                return
            near, size = self.vectors @ x[some].T, self.norm[:, None] * length[some]
            rounding = 4 * x.shape[1] * np.finfo(np.float64).eps
            open_[:, some] &= ~(near + rounding * size < self.bar[:, None])
            self._take(open_, ids, x)

    def _take(self, wanted: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Scores the wanted pairs as the result does, component by component, and keeps the best."""
        row, at = np.nonzero(wanted)
        for s in range(0, len(row), PAIRS):
            r, a = row[s : s + PAIRS], at[s : s + PAIRS]
            total = np.zeros(len(r))
            for i in range(x.shape[1]):
                total += self.vectors[r, i] * x[a, i]
            row_, found, score = np.append(self.row, r), np.append(self.found, ids[a]), np.append(self.score, total)
            order = np.lexsort((found, -score, ~np.isnan(score), row_))  # a score that is no number is the largest, as in Spark
            row_, found, score = row_[order], found[order], score[order]
            fresh = np.zeros(len(row_), bool)
            again = np.lexsort((found, row_))
            fresh[again] = np.append(True, (np.diff(row_[again]) != 0) | (np.diff(found[again]) != 0))
            place = np.cumsum(fresh)
            place -= (place - fresh)[np.searchsorted(row_, row_)]
            last = (place == self.k + 1) & fresh
            self.bar[row_[last]] = np.where(np.isnan(score[last]), -np.inf, score[last])
            keep = (place <= self.k) | last
            self.row, self.found, self.score = row_[keep], found[keep], score[keep]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.found)], ["query_id", "id"])


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    """Vectors of single or double precision, as doubles."""
    kinds = [("<f4", 4 * dims), ("<f8", 8 * dims)]
    out, sizes = np.empty((len(rows), dims)), np.fromiter(map(len, rows), np.int64, len(rows))
    for kind, size in kinds:
        own = np.flatnonzero(sizes == size)
        out[own] = np.frombuffer(b"".join(rows[i] for i in own), kind).reshape(-1, dims)
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE)) AND exists(v, x -> x <> 0)"
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL").filter(finite)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0].n if lengths else 0))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, rerank: int = 300, fit_rows: int = 10_000, group: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query among the other rows.

    ``queries`` has the same columns; a row never finds its own id.  By default every row is a query.
    """
    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col) if queries is not None else rows
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    # Equal vectors: the ids a result can show are the smallest k + 1 (one may be the query itself).
    few = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("place") <= k + 1)
    index = written(few.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("id")).alias("ids")), "vectors")
    total = index.count()
    sample = index.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").toArrow().column("v").combine_chunks()
    if not total:
        return _ranked(index.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")), k)
    q = train(_vectors(sample), group)
    n_queries = asked.count()
    code_blocks = math.ceil(total / max(1, min(CODE_BLOCK, BLOCK_VALUES // q.dims)))
    # Each block of queries needs a copy of the codes: larger blocks where there are enough to share out.
    query_blocks = max(1, math.ceil(n_queries / (4 * QUERY_BLOCK)), min(QUERY_BLOCKS, math.ceil(n_queries / QUERY_BLOCK)))

    def encode(batches):
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column("v"))
                with np.errstate(all="ignore"):
                    codes, single = q.encode(x), x.astype("<f4")
                short = (single == x).all(1)
                exact = [s.tobytes() if e else v.tobytes() for s, v, e in zip(single, x, short, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(exact, pa.binary())], ["id", "code", "x"])

    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    codes = index.select("id", "v").mapInArrow(encode, "id long, code binary, x binary").withColumn("cb", dealt(code_blocks))
    code_rows = codes.groupBy("cb").agg(F.collect_list(F.struct("id", "code", "x")).alias("codes"))
    query_rows = asked.withColumn("qb", dealt(query_blocks)).groupBy("qb").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    # A block of queries, then every block of codes: one pass that keeps each query's best so far.
    met = (
        code_rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        .unionByName(query_rows.withColumn("cb", F.lit(-1)), allowMissingColumns=True)
        .repartition("qb")
        .sortWithinPartitions("qb", "cb")
        .select("queries", "codes")
    )

    def search(batches):
        asking = None
        for b in batches:
            for r in range(b.num_rows):
                ask, held = b.column("queries")[r], b.column("codes")[r]
                if ask.is_valid:
                    if asking is not None:
                        yield asking.rows()
                    asking = _Best(q, ask.values.field(0).to_numpy(), _vectors(ask.values.field(1)), k, rerank)
                elif asking is not None:
                    ids = held.values.field(0).to_numpy()
                    code = np.frombuffer(b"".join(held.values.field(1).to_pylist()), np.uint8).reshape(len(ids), -1)
                    order = np.argsort(ids)
                    asking.meet(ids[order], code[order], _unpacked(held.values.field(2).to_pylist(), q.dims)[order])
        if asking is not None:
            yield asking.rows()

    best = written(met.mapInArrow(search, "query_id long, id long"), "near", arrow_rows=4)
    exact = F.expr("aggregate(zip_with(qv, v, (a, b) -> CAST(a AS DOUBLE) * CAST(b AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)")
    scored = (
        best.join(index, "id")
        .join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
        .select("query_id", "ids", exact.alias("score"))
        .select("query_id", F.explode("ids").alias("vec_id"), "score")
        .filter("vec_id <> query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    return _ranked(scored, k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
