"""Tables written between the steps of one operator, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.words import U, mix

_SETTING = "spark.checkpoint.dir"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a temporary one, in local mode (tests) alone."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet and read again: cuts the lineage and survives lost executors.

    ``arrow_rows`` bounds the rows of an Arrow batch while it runs, for rows that hold whole groups.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docquarry/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_ARROW_ROWS)
    if arrow_rows:
        spark.conf.set(_ARROW_ROWS, str(arrow_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", size: str = "rows") -> DataFrame:
    """``rows`` joined with ``facts``, unique by ``keys``, without hot keys in one task; both are written tables.

    ``size`` is the column of ``facts`` that counts the rows of a key (it is left out of the result).  Keys that
    more than a ten-thousandth of the rows share (at least 4096 of them) are hot; there are at most ten
    thousand of these by arithmetic, so their facts are broadcast.  Others meet in a shuffle.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    total = rows.count()
    known = facts.drop(size)
    hot = facts.filter(F.col(size) > max(4096, total // 10_000)).drop(size)
    if total <= 4096 or hot.isEmpty():
        return rows.join(known, keys, how)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(known, keys, how)
    return rest.unionByName(rows.join(F.broadcast(hot), keys))


def give_back() -> None:
    """Returns the memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator], every: float = 1.0) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, whose worker returns freed memory each second and at its end, as it lives on beside later steps."""

    def whole(batches):
        last = time.monotonic()
        try:
            for out in run(batches):
                yield out
                del out
                if time.monotonic() - last > every:
                    give_back()
                    last = time.monotonic()
        finally:
            give_back()

    return whole


def _places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(U))
    return [x & U(size - 1) for x in (h, h >> U(32))]


def sieve(ids: DataFrame, most: int = 26) -> Callable[[np.ndarray], np.ndarray]:
    """A Bloom filter of ``ids(id)``, of at most 2 ** ``most`` bits: true for every one of them and for few others.

    Rows that it turns away need not be shuffled; the rest needs an exact join.  Beyond a million ids or so
    for each 2 ** 24 bits it lets more through, and nothing else changes.
    """
    ids = ids.filter(F.col("id").isNotNull())
    size = 1 << min(most, max(16, (16 * ids.count()).bit_length()))

    def run(batches):
        bits = np.zeros(size // 64, U)
        for b in batches:
            for at in _places(b.column("id").to_numpy(), size):
                np.bitwise_or.at(bits, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
        at = np.flatnonzero(bits)
        for s in range(0, len(at), 100_000):
            some = at[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bits[some].view(np.int64))], ["word", "bits"])

    found = ids.select("id").mapInArrow(lean(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, U)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.int64).view(U)

    def holds(ids: np.ndarray) -> np.ndarray:
        one, two = (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1) for at in _places(ids, size))
        return (one & two).astype(bool)

    return holds


def among(rows: DataFrame, holds: Callable[[np.ndarray], np.ndarray], wanted: bool = True) -> DataFrame:
    """The rows whose ``id`` a sieve holds, or doesn't."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(holds(b.column("id").to_numpy()) == wanted))

    return rows.mapInArrow(lean(run), rows.schema)
