"""Near-duplicate detection by a chosen-path set similarity join.

A document's set is its distinct five-word shingles (lower-cased A-Z).  Documents
with equal sets are one *class*, and only its smallest id goes on.  A class has
``TOKENS`` minwise tokens, which choose its paths, and a *sketch*: the least shingle
hash in each of ``BINS`` bins, four bits of it, which estimates similarities closely.

Chosen paths: every tree starts with all classes in its root.  A node chooses
``BRANCH`` of the minwise tokens by a hash of its own name, and a class moves to
the child named by (node, token number, token).  Two sets of similarity s agree
on a token with probability s, so a pair at the threshold survives a tree with a
probability that ``trees_for`` derives from the branching process; independent
trees are repeated until the target recall is met.  Nodes with one class vanish,
nodes of at most ``LEAF`` classes are compared exhaustively, larger ones branch
again until none is left.

A large node in which ``DENSE`` of the classes agree on a chosen token is a *family*:
that child would be the node again, so it is not followed.  Families of one profile
are taken together.  Their members branch on all tokens but the commonest of each
number, its *profile* (children hold at most half of the family, so depth is
logarithmic; a token that one member has is left out, and in a family found inside
another one every token whose holders there met in a leaf already), are compared within dealt chunks, and those whose similarity to the
family's most typical member is above ``similarity - SLACK`` (its *core*) also against
each other wherever they are not connected yet.  A pair outside the core shares more
than ``SLACK`` beside the profile, and is met on such a token.

Comparing nodes takes two steps, so that not all pairs of alike texts are confirmed:
first the strongest pairs that connect a node (families before leaves, which then only
connect what differs in component); then, given the components found, the remaining
pairs whose components differ.  A pair needs a sketch estimate within four and a half
deviations of the threshold and is confirmed on the full sets (48-bit shingle hashes) of
the whole texts.  Only confirmed links form components.

Scale: the paths are long integers dealt by node name; counts per node combine on
the map side; no task gathers more than a chunk or a block of a node.  A leaf is one row with
its ids.  Tokens, sketches and texts pass a Bloom filter of bounded size before a join, so
only those that may be asked for are shuffled; only texts of classes that share a node are
kept, compressed, and those of the pairs to confirm are fetched for pairs, never for blocks.
Sketches go to leaves that are not yet one component.  The one quadratic step is a core that hangs
between threshold and threshold - SLACK without links, at 256 bytes a member.

Defined results: null or empty texts have an empty set, link with nothing and are
kept; one to four words are one shingle; rows that repeat an id count as one
document, for which the row with the largest set (then identity) speaks, and each get
a row; rows with a null id are documents by their text, count
as larger than every id and are shown as null (inside, their ids are hashes above the
largest id, so the room above it bounds how many can be told apart); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.components import components
from docquarry.llm.shared import among, lean, sieve, spread_join, written
from docquarry.llm.substring_dedup import _pieces
from docquarry.llm.words import U, as_bytes, hash_words, mix, span_hashes, window_hashes

SHINGLE, TOKENS, BRANCH, LEAF, BLOCK = 5, 64, 2, 64, 1024
DENSE, SLACK, CHUNKINGS, PROFILE = 0.6, 0.07, 3, 5
BINS, PLANES = 512, 4  # of a sketch: bins, and bits of each
WORDS = BINS // 64
_NO_ID = 2**63 - 1
_rng = np.random.Generator(np.random.PCG64(77))
_MULTIPLIER = _rng.integers(0, 2**31, TOKENS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADDEND = _rng.integers(0, 2**32, TOKENS, dtype=np.int64).astype(np.uint32)


def trees_for(similarity: float, recall: float) -> int:
    """Trees after which a pair of this similarity has shared a leaf with probability ``recall``."""
    lost = 0.0
    for _ in range(64):  # to the fixed point, for depth has no bound
        lost = (1 - similarity * (1 - lost)) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles as text << 48 | 48-bit hash, ascending; set size of every text). Under 65536 texts."""
    words, offsets = hash_words(texts, lower=True)
    n = np.diff(offsets)
    full = np.maximum(n - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(n)), full)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(offsets[:-1], full)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    hashes = np.concatenate([window_hashes(words, SHINGLE)[at] if len(at) else np.empty(0, U), span_hashes(words, offsets[short], offsets[short + 1]) + n[short].astype(U)])
    keys = np.concatenate([owner, short]).astype(U) << U(48) | hashes >> U(16)
    keys = np.unique(keys)
    return keys, np.bincount((keys >> U(48)).astype(np.int64), minlength=len(n))


def sketches(keys: np.ndarray, rows: int) -> np.ndarray:
    """[rows, PLANES * BINS / 8] bytes: by bin, 1 to 15 from the least hash in it, 0 where it is empty; as bit planes."""
    values = np.zeros(rows * BINS, np.uint8)
    cell = (keys >> U(48 - 9)).astype(np.int64)  # text, then the hash's upper nine bits
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # keys ascend
    values[cell[first]] = (keys[first] & U(0xFFFF)) % U(15) + U(1)
    values = values.reshape(rows, BINS)
    return np.concatenate([np.packbits(values >> p & 1, axis=1) for p in range(PLANES)], 1)


def _describe(batches):
    """Size, 128-bit identity, minwise tokens and sketch of every document's set."""
    for b in _pieces(batches, most=1 << 21):
        for i in range(0, b.num_rows, 8_000):
            part = b.slice(i, 8_000)
            keys, sizes = shingle_sets(as_bytes(part.column("text")))
            has = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[has]
            h = mix(keys & U(2**48 - 1))
            ident = np.zeros((2, len(sizes)), U)
            tokens = np.zeros((len(sizes), TOKENS), np.uint32)
            if len(has):
                ident[0, has] = np.add.reduceat(h, starts)
                ident[1, has] = np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), starts)
                short = (h >> U(32)).astype(np.uint32)
                for k in range(TOKENS):
                    tokens[has, k] = np.minimum.reduceat(short * _MULTIPLIER[k] + _ADDEND[k], starts)
            flat = pa.array(tokens.view(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * TOKENS), flat)
            sketch = pa.array([x.tobytes() for x in sketches(keys, len(sizes))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(ident[0].view(np.int64)), pa.array(ident[1].view(np.int64)), lists, sketch], ["doc_id", "n", "h1", "h2", "tokens", "sketch"])


def _compress(holds):
    """Packed texts of the rows whose id a sieve holds."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        some = (b.filter(pa.array(holds(b.column("doc_id").to_numpy()))) for b in batches)
        for b in _pieces(some, most=1 << 21):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([pack(x) for x in as_bytes(b.column("text"))], pa.binary())], ["id", "packed"])

    return run


# ---------------------------------------------------------------- paths


def _number(node: Column, k: int) -> Column:
    """The k-th token number that a node chooses; the chosen numbers differ."""
    one = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(TOKENS))
    number = one if k == 0 else F.pmod(one + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(TOKENS - 1)), F.lit(TOKENS))
    return number.cast("int")


def _chosen(tokens: str = "tokens") -> Column:
    """array<struct(slot, token)> of the tokens chosen by ``node``."""
    return F.array(*[F.struct(_number(F.col("node"), k).alias("slot"), F.get(F.col(tokens), _number(F.col("node"), k)).alias("token")) for k in range(BRANCH)])


def _child() -> Column:
    return F.xxhash64("node", F.col("c.slot"), F.col("c.token"))


def _counted(rows: DataFrame, slots: Column) -> DataFrame:
    """(node, size, slot, token, n): how many of a node's classes have a token."""
    return rows.select("node", "size", F.explode(slots).alias("c")).groupBy("node", "size", "c.slot", "c.token").agg(F.count(F.lit(1)).alias("n"))


def _spread(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows(node, id, size, ...)`` with their node's ``facts``; a large node is dealt over many tasks."""
    parts = F.ceil(F.col("size") / 4096).cast("int")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    return dealt.join(facts.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("size"), ["node", "part"]).drop("part")


def _families(held: DataFrame, dense: DataFrame) -> DataFrame:
    """(node, id, root, size): the dense nodes' members, nodes of one profile taken together unless they come from a family (root)."""
    rows = held.join(dense, "node")
    if held.filter("root IS NULL").isEmpty():
        return _distinct_nodes(rows.select("node", "id", "root", "size"))
    fixed = F.array(*[F.struct(F.lit(k).alias("slot"), F.get("tokens", F.lit(k)).alias("token")) for k in range(0, TOKENS, TOKENS // PROFILE)])
    modes = _counted(rows.filter("root IS NULL"), fixed).groupBy("node", "slot").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    profile = modes.groupBy("node").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("slot", "token")))).alias("family"))
    named = rows.join(profile, "node", "left").select(F.coalesce("family", "node").alias("node"), "id", "root").distinct()
    named = written(named, "families")
    sizes = named.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    return _distinct_nodes(named.join(sizes, "node"))


def _branch_family(family: DataFrame, heavy: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Children (node, id, root) by the tokens beside a family's profile; the most typical member (node, hub) of each; heavy tokens.

    A token that one member has makes no child.  In a family that comes from another (``root``), neither does one that
    at most LEAF members of that have: all of them meet in a leaf there.  The others, ``heavy(id)``, are named as children.
    """
    slots = F.transform("tokens", lambda t, i: F.struct(i.alias("slot"), t.alias("token")))
    shared = written(_counted(family, slots).filter("n > 1").withColumn("id", F.xxhash64("node", "slot", "token")), "shared")
    modes = shared.groupBy("node", "size", "slot").agg(F.max(F.struct("n", "token")).alias("most"))
    common = F.when(F.col("most.n") > LEAF, F.struct("slot", "most.token"))  # a slot without a common token branches on all
    agreed = modes.groupBy("node", "size").agg(F.map_from_entries(F.collect_list(common)).alias("agreed"))
    light = F.filter(slots, lambda c: F.coalesce(F.col("agreed")[c["slot"]] != c["token"], F.lit(True)))
    told = _spread(family, agreed).select("node", "id", "root", light.alias("light"))
    named = lambda by: F.transform("light", lambda c: F.xxhash64(by, c["slot"], c["token"]))
    told = written(told.select("node", "id", "root", named("node").alias("child"), named("root").alias("above")), "light")
    hubs = told.groupBy("node").agg(F.max_by("id", F.struct(-F.size("child"), -F.col("id"))).alias("hub"))
    children = told.mapInArrow(lean(_children(sieve(shared), heavy and sieve(heavy))), "node long, id long, root long")
    return children, hubs, shared.filter(F.col("n") > LEAF).select("id")


def _children(shared, heavy):
    """One row of each child that a sieve of shared and, below another family, one of its heavy tokens holds."""

    def run(batches):
        for b in batches:
            child = b.column("child")
            owner = np.repeat(np.arange(b.num_rows), child.value_lengths().to_numpy())
            node = child.flatten().to_numpy()
            ok = shared(node)
            if heavy:
                ok &= b.column("root").is_null().to_numpy(zero_copy_only=False)[owner] | heavy(b.column("above").flatten().to_numpy())
            owner = pa.array(owner[ok])
            yield pa.RecordBatch.from_arrays([pa.array(node[ok]), b.column("id").take(owner), b.column("node").take(owner)], ["node", "id", "root"])

    return run


def _distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One of the nodes that hold the same classes."""
    sums = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2"))
    return nodes.join(sums.groupBy("n", "h1", "h2").agg(F.min("node").alias("node")).select("node"), "node", "left_semi")


def _nodes(classes: DataFrame, trees: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Leaves (node, ids) of two classes to LEAF, no two with the same ones; families (node, id, size); hubs (node, hub)."""
    tokens = classes.select("id", "tokens")
    open_ = tokens.select("id", "tokens", F.explode(F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in range(trees)])).alias("node"), F.lit(None).cast("long").alias("root"))
    leaves, families, hubs, light, heavy = None, None, None, None, None
    both = lambda x, y: y if x is None else x.unionByName(y)
    while True:
        child = open_.select("id", "node", "root", F.explode(_chosen()).alias("c")).select(_child().alias("node"), "id", "root")
        child = written(both(light, child).distinct(), "paths")
        sizes = child.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        level = written(child.join(sizes, "node"), "nodes")
        leaves = both(leaves, level.filter(F.col("size") <= LEAF).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids")))
        large = level.filter(F.col("size") > LEAF)
        if large.isEmpty():
            break
        near = written(among(tokens, sieve(written(large.select("id").distinct(), "asked"))), "near")
        held = written(large.join(near, "id").select("node", "id", "size", "root", "tokens"), "open")
        most = _counted(held, _chosen()).groupBy("node", "size").agg(F.max("n").alias("most"))
        dense = written(most.filter(F.col("most") >= DENSE * F.col("size")).select("node"), "dense")
        open_ = held.join(dense, "node", "left_anti").select("id", "tokens", "node", "root")
        light = None
        if not dense.isEmpty():
            family = written(_families(held, dense), "families")
            light, hub, more = _branch_family(family.join(near, "id"), heavy)
            families, hubs, heavy = both(families, family.drop("root")), both(hubs, hub), both(heavy, more)
    return leaves.groupBy("ids").agg(F.min("node").alias("node")).select("node", "ids"), families, hubs


def _apart(leaves: DataFrame, told: DataFrame) -> DataFrame:
    """(node, id) of the leaves whose members are not all of one component."""
    rows = leaves.select("node", F.explode("ids").alias("id")).join(told.select("id", "label"), "id")
    nodes = rows.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.collect_list("id").alias("ids")).filter("lo <> hi")
    return written(nodes.select("node", "ids"), "apart").select("node", F.explode("ids").alias("id"))


# ---------------------------------------------------------------- comparing


def _item() -> Column:
    return F.struct("id", "n", "sketch", "label")


def _planes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes [rows, PLANES, WORDS] of sketches, and which bins are not empty."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PLANES, WORDS)
    return x, np.bitwise_or.reduce(x, axis=1)


def _likely(x: tuple[np.ndarray, np.ndarray], nx: np.ndarray, y: tuple[np.ndarray, np.ndarray], ny: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarities [x, y], and whether they may reach ``similarity``."""
    count = lambda z: np.bitwise_count(z).sum(2, dtype=np.int32)
    both = x[1][:, None] & y[1][None]
    differ = np.zeros_like(both)
    for p in range(PLANES):
        differ |= x[0][:, None, p] ^ y[0][None, :, p]
    shared = count(both)
    bins = np.maximum(count(x[1][:, None] | y[1][None]), 1)
    estimate = (count(both & ~differ) - shared / 15) / (1 - 1 / 15) / bins  # one in fifteen agrees by chance
    union = (nx[:, None] + ny[None]) / (1 + similarity)
    spread = np.sqrt((similarity * (1 - similarity) * np.maximum(1 - bins / np.maximum(union, 1), 0) + (1 - similarity) / 15) / bins)
    ok = estimate >= similarity - 4.5 * spread - 1e-9
    return estimate, ok & (np.minimum(nx[:, None], ny[None]) >= similarity * np.maximum(nx[:, None], ny[None]))


def _members(column: pa.Array):
    """Offsets, then ids, set sizes, sketches and labels of the members of each row's list."""
    return column.offsets.to_numpy(), column.values.field(0).to_numpy(), column.values.field(1).to_numpy(), _planes(column.values.field(2)), column.values.field(3).to_numpy()


def _cut(x: tuple[np.ndarray, np.ndarray], s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    return x[0][s:e], x[1][s:e]


def _connect(similarity: float):
    """Within each chunk: the pairs of a forest that joins all labels it can by the strongest estimates (node is null).

    Further likely pairs follow with their node; where they would take more room than sketches, a null pair names the node.
    """

    free = 9.0  # above all likely pairs: what one label already joins

    def run(batches):
        for b in batches:
            a_out, b_out, a_more, b_more, node_more, node_out = [], [], [], [], [], []
            offsets, ids, n, planes, label = _members(b.column("members"))
            nodes = b.column("node").to_pylist()
            for r, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                m = e - s
                if m < 2:
                    continue
                est, ok = _likely(_cut(planes, s, e), n[s:e], _cut(planes, s, e), n[s:e], similarity)
                same = label[s:e, None] == label[None, s:e]
                likely = np.where(ok & ~same, est + 2.0, 0.0)  # likely pairs are above zero
                if not likely.any():
                    continue
                est = np.where(same, free, likely)
                np.fill_diagonal(est, 0)
                best, link, todo = est[0].copy(), np.zeros(m, np.int64), np.ones(m, bool)
                todo[0] = False
                used = 0
                for _ in range(m - 1):  # Prim; a new tree begins where nothing reaches
                    k = int(np.argmax(np.where(todo, best, -1.0)))
                    todo[k] = False
                    if 0 < best[k] < free:
                        used += 1
                        a_out.append(ids[s + k])
                        b_out.append(ids[s + link[k]])
                    better = est[k] > best
                    best[better], link[better] = est[k][better], k
                i, j = np.nonzero(np.triu(likely))
                if len(i) > used and (nodes[r] is None or len(i) > 8 * m):
                    node_out.append(nodes[r])
                elif len(i) > used:
                    a_more += ids[s + i].tolist()
                    b_more += ids[s + j].tolist()
                    node_more += [nodes[r]] * len(i)
            pairs = _pairs_batch(a_out + a_more, b_out + b_more)
            pad = lambda c, k: pa.concat_arrays([c, pa.nulls(k, pa.int64())])
            names = pa.concat_arrays([pa.nulls(len(a_out), pa.int64()), pa.array(node_more + node_out, pa.int64())])
            yield pa.RecordBatch.from_arrays([pad(pairs.column(0), len(node_out)), pad(pairs.column(1), len(node_out)), names], ["a", "b", "node"])

    return run


def _across(similarity: float):
    """Likely pairs between ``asked`` and ``held`` members whose components differ."""

    def run(batches):
        for b in batches:
            a_out, b_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            sides = [_members(b.column(c)) for c in ("asked", "held")]
            for r in range(b.num_rows):
                (s, e), (hs, he) = ((side[0][r], side[0][r + 1]) for side in sides)
                (_, ids, n, planes, label), (_, hids, hn, hplanes, hlabel) = sides
                for at in range(s, e, 64):
                    to = min(at + 64, e)
                    _, ok = _likely(_cut(planes, at, to), n[at:to], _cut(hplanes, hs, he), hn[hs:he], similarity)
                    i, j = np.nonzero(ok & (label[at:to, None] != hlabel[None, hs:he]))
                    a_out.append(ids[at + i])
                    b_out.append(hids[hs + j])
            yield _pairs_batch(np.concatenate(a_out), np.concatenate(b_out))

    return run


def _typical(similarity: float):
    """The rows whose sketch may be as similar as this to their hub's."""

    def run(batches):
        for b in batches:
            x, y = _planes(b.column("sketch")), _planes(b.column("hub_sketch"))
            n, m = b.column("n").to_numpy(), b.column("hub_n").to_numpy()
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                est = _likely(_cut(x, i, i + 1), n[i : i + 1], _cut(y, i, i + 1), m[i : i + 1], similarity)[0]
                ok[i] = est[0, 0] >= similarity
            yield b.filter(pa.array(ok)).select(["node", "id", "size", "label", "n", "sketch"])

    return run


def _pairs_batch(a: list | np.ndarray, b: list | np.ndarray) -> pa.RecordBatch:
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _confirm(percent: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(0, b.num_rows, 400):
                part = b.slice(i, 400)
                x, nx = shingle_sets([unpack(t) for t in part.column("packed_a").to_pylist()])
                y, ny = shingle_sets([unpack(t) for t in part.column("packed_b").to_pylist()])
                common = np.bincount((np.intersect1d(x, y, assume_unique=True) >> U(48)).astype(np.int64), minlength=part.num_rows)
                ok = pa.array(100 * common >= percent * (nx + ny - common))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    asked = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "asked")
    texts = among(packed, sieve(asked))
    at = lambda c: texts.select(F.col("id").alias(c), F.col("packed").alias(f"packed_{c}"))
    both = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "packed_a", "packed_b")
    return written(both.mapInArrow(lean(_confirm(percent)), "a long, b long"), "links", arrow_rows=400)


# ---------------------------------------------------------------- the operator


def _keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, int]:
    """Ids in which every text without one has its own, and the largest id given."""
    last = docs.agg(F.max(F.col(id_col).cast("long"))).first()[0]
    last = -1 if last is None else last
    room = F.pmod(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(max(1, min(_NO_ID, _NO_ID - last))))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(min(last + 1, _NO_ID)) + room), last


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, recall: float = 0.9999) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    key, last = _keys(docs, id_col, text_col)
    found = _found(docs, key, text_col, percent, recall)
    shown = lambda c: F.when(F.col(c) <= last, F.col(c))
    return found.select(shown("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, recall: float = 0.9999) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows without an id and with one text, one stays."""
    key, last = _keys(docs, id_col, text_col)
    kept = _found(docs, key, text_col, percent, recall).filter("doc_id = component_id").select(F.col("doc_id").alias("__key")).distinct()
    rows = docs.withColumn("__key", key).join(kept, "__key", "left_semi")
    nameless = rows.filter(F.col(id_col).isNull()).dropDuplicates(["__key"])
    return rows.filter(F.col(id_col).isNotNull()).unionByName(nameless).drop("__key")


def _found(docs: DataFrame, key: Column, text_col: str, percent: int, recall: float) -> DataFrame:
    """doc_id, n, component_id by ``key``, for every row."""
    similarity = percent / 100
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sets = written(rows.mapInArrow(lean(_describe), "doc_id long, n long, h1 long, h2 long, tokens array<int>, sketch binary"), "sets", arrow_rows=2000)
    identity = F.struct("n", "h1", "h2")
    repeated = written(sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(identity).alias("best")).filter("rows > 1").select("doc_id", "best"), "repeated")
    speaking = sets.drop("tokens", "sketch")
    if not repeated.isEmpty():
        speaking = speaking.join(repeated, "doc_id", "left").filter(F.col("best").isNull() | (identity == F.col("best"))).drop("best").distinct()
        speaking = written(speaking, "speaking")
    equal = written(speaking.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows")), "equal")
    member = written(spread_join(speaking.filter("n > 0"), equal, ["n", "h1", "h2"]).select("doc_id", "n", "id"), "member")
    named = sets.filter("n > 0").withColumnRenamed("doc_id", "id")
    if repeated.isEmpty():
        named, spare = named.drop("h1", "h2"), member.filter("doc_id <> id").select(F.col("doc_id").alias("id"))
        doubt = sieve(spare)  # all rows beside these are classes
        classes = among(named, doubt, False).unionByName(among(named, doubt).join(spare, "id", "left_anti"))
    else:
        classes = named.join(equal.drop("rows"), ["id", "n", "h1", "h2"]).drop("h1", "h2").dropDuplicates(["id"])
    classes = written(classes, "classes")

    leaves, families, hubs = _nodes(classes, trees_for(similarity, recall))
    leaves = written(leaves, "leaves")
    held = leaves.select(F.explode("ids").alias("id"))
    held = held if families is None else held.unionByName(families.select("id"))
    holds = sieve(written(held.distinct(), "held"))
    packed = written(rows.mapInArrow(lean(_compress(holds)), "id long, packed binary"), "texts", arrow_rows=2000)
    if not repeated.isEmpty():
        packed = _speaking_texts(packed, repeated)

    told = written(among(classes.select("id", "n", "sketch"), holds).withColumn("label", F.col("id")), "sketches")
    tried, links, labels = None, None, None
    if families is not None:  # first, so that leaves inside a component need no further comparison
        dealt = F.explode(F.array(*[F.struct(F.lit(c).alias("way"), F.pmod(F.xxhash64("node", "id", F.lit(c)), F.ceil(F.col("size") / LEAF)).alias("chunk")) for c in range(CHUNKINGS)]))
        kin = sieve(written(families.select("id").distinct(), "asked"))
        alike = families.join(among(told, kin), "id").withColumn("c", dealt).groupBy("node", "c").agg(F.sort_array(F.collect_list(_item())).alias("members"))
        tried = _forest(alike.select(F.lit(None).cast("long").alias("node"), "members"), similarity).select("a", "b").distinct()
        tried = written(tried, "pairs")
        links = _confirmed(tried, packed, percent)
        labels = written(components(links), "labels")
        told = _labelled(told, labels)
    rest = leaves.select("node", F.explode("ids").alias("id")) if labels is None else _apart(leaves, told)
    chunks = rest.join(told, "id").groupBy("node").agg(F.sort_array(F.collect_list(_item())).alias("members"))
    forest = _forest(chunks, similarity)
    fresh = forest.filter("a IS NOT NULL AND node IS NULL").select("a", "b").distinct()
    fresh = written(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
    tried, links, labels = _further(fresh, tried, links, labels, packed, percent)
    told = _labelled(told, labels)

    more = _apart(leaves.join(forest.filter("a IS NULL").select("node"), "node", "left_semi"), told)
    label = lambda c: told.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    likely = forest.filter("a IS NOT NULL AND node IS NOT NULL").select("a", "b").distinct()
    likely = likely.join(label("a"), "a").join(label("b"), "b").filter("a_label <> b_label").select("a", "b")
    likely = likely.unionByName(_cross_pairs(more, among(told, sieve(more)), similarity))
    if families is not None:
        likely = likely.unionByName(_core_pairs(families, hubs, among(told, kin), similarity))
    likely = written(likely.distinct().join(tried, ["a", "b"], "left_anti"), "pairs", arrow_rows=16)
    labels = _further(likely, tried, links, labels, packed, percent)[2]

    placed = member.join(labels, "id", "left").select("doc_id", "n", F.coalesce("label", "id").alias("component_id"))
    placed = placed.unionByName(speaking.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return placed if repeated.isEmpty() else sets.select("doc_id", "n").join(placed.drop("n"), "doc_id")


def _forest(chunks: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that join the members of each chunk; (null, null, node) of nodes with further likely pairs."""
    return written(chunks.mapInArrow(lean(_connect(similarity)), "a long, b long, node long"), "forest", arrow_rows=200)


def _further(fresh: DataFrame, tried: DataFrame | None, links: DataFrame | None, labels: DataFrame | None, packed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tried pairs, links and labels (id, label) after ``fresh`` pairs were tried too."""
    if labels is not None and fresh.isEmpty():
        return tried, links, labels
    found = _confirmed(fresh, packed, percent)
    tried = fresh if tried is None else tried.unionByName(fresh)
    if labels is not None and found.isEmpty():
        return tried, links, labels
    links = found if links is None else links.unionByName(found)
    return tried, links, written(components(links), "labels")


def _labelled(told: DataFrame, labels: DataFrame) -> DataFrame:
    """``told`` with the labels of components; an id without one is its own."""
    return written(told.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "sketches")


def _speaking_texts(packed: DataFrame, repeated: DataFrame) -> DataFrame:
    """The text that speaks for each id: one of the set named in ``repeated``."""

    def told(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts = pa.array([unpack(t).decode() for t in b.column("packed").to_pylist()], pa.string())
            found = list(_describe([pa.RecordBatch.from_arrays([b.column("id"), texts], ["doc_id", "text"])]))
            parts = [pa.concat_arrays([d.column(c) for d in found]) if found else pa.array([], pa.int64()) for c in ("n", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([b.column("id"), *parts, b.column("packed")], ["id", "n", "h1", "h2", "packed"])

    best = repeated.select(F.col("doc_id").alias("id"), "best.n", "best.h1", "best.h2")
    several = packed.join(best.select("id"), "id").mapInArrow(lean(told), "id long, n long, h1 long, h2 long, packed binary")
    one = several.join(best, ["id", "n", "h1", "h2"]).groupBy("id").agg(F.min("packed").alias("packed"))
    return written(packed.join(best.select("id"), "id", "left_anti").unionByName(one), "texts")


def _cross_pairs(nodes: DataFrame, told: DataFrame, similarity: float) -> DataFrame:
    """Likely pairs of leaves whose components differ."""
    members = nodes.join(told, "id").groupBy("node").agg(F.collect_list(_item()).alias("held"))
    return members.select(F.col("held").alias("asked"), "held").mapInArrow(lean(_across(similarity)), "a long, b long")


def _core_pairs(families: DataFrame, hubs: DataFrame, told: DataFrame, similarity: float) -> DataFrame:
    """Likely pairs of a family's core: strays (outside its main component) against all, in blocks."""
    sketch = told.drop("label")
    labelled = written(families.join(told.select("id", "label"), "id").select("node", "id", "size", "label"), "members")
    parts = labelled.groupBy("node", "size", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("node", "size").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).getField("label").alias("main")).filter("labels > 1")
    hub = mixed.join(hubs, "node").join(sketch.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch")), "hub")
    rows = _spread(labelled.join(sketch, "id"), hub.select("node", "size", "hub_n", "hub_sketch"))
    core = written(rows.mapInArrow(lean(_typical(similarity - SLACK)), "node long, id long, size long, label long, n long, sketch binary"), "core", arrow_rows=2000)
    sizes = core.groupBy("node").agg(F.count(F.lit(1)).alias("core"))
    members = core.join(sizes, "node").join(mixed.select("node", "main"), "node")
    blocks = F.ceil(F.col("core") / BLOCK).cast("int")
    item = _item().alias("item")
    block = F.pmod(F.xxhash64("node", "id"), blocks).cast("int").alias("block")
    # Strays are dealt too, so that no task gathers all of a node's strays.
    dealt = members.filter("label <> main").select("node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), block.alias("deal"), item)
    asked = dealt.groupBy("node", "block", "deal").agg(F.collect_list("item").alias("asked"))
    held = members.select("node", block, item).groupBy("node", "block").agg(F.collect_list("item").alias("held"))
    return asked.join(held, ["node", "block"]).select("asked", "held").mapInArrow(lean(_across(similarity)), "a long, b long")
