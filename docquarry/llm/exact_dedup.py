"""Exact deduplication with skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after every ASCII white-space character
is deleted.  Of equal texts the row with the most code points stays, then the
smallest id.

Three combining stages, each of which groups by the *whole normalised text*
(the digest only routes rows, it never decides equality):

1. local: Spark's partial aggregate merges equal texts inside each map task;
2. salted: the digest's rows are dealt over ``salts`` reducers, so a text that
   makes up a third of the corpus is merged by many tasks;
3. global: at most ``salts`` winners of a text meet and are combined.

The winner of a text is one decimal (code points, then id reversed), so every
stage is a hash aggregate with fixed-width buffers.  Decisions return to the
rows by a join on the digest; digests shared by different texts (none in
practice) are resolved by a join on digest and text.

Defined results: null text counts as empty; empty texts equal each other; a
null id sorts last and is returned as null; an empty table gives no rows;
repeated rows each get a row, ``group_size`` counts them all; other columns of
the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import spread_join, written

SPACES = r"[\x20\x09-\x0D]+"
_NO_ID = 2**63 - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _rank_key(points: Column, doc_id: Column) -> Column:
    """points * 2^64 - id: larger is better; a plain number, so that max() needs no sort."""
    return points.cast("decimal(10,0)") * F.expr("18446744073709551616BD") - doc_id.cast("decimal(19,0)")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"),
        normalised(text).alias("norm"),
        F.length(text).alias("points"),
    ).withColumn("sha", F.sha2("norm", 256))

    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .withColumn("key", _rank_key(F.col("points"), F.col("doc_id")))
        .groupBy("sha", "salt", "norm")
        .agg(F.max("key").alias("key"), F.count(F.lit(1)).alias("n"))
    )
    classes = (
        salted.groupBy("sha", "norm")
        .agg(F.max("key").alias("key"), F.sum("n").alias("group_size"))
        .withColumn("best", F.expr("(key + 9223372036854775808BD) div 18446744073709551616BD"))
        .withColumn("keep_id", (F.col("best").cast("decimal(10,0)") * F.expr("18446744073709551616BD") - F.col("key")).cast("long"))
    )
    # A digest is settled if one text has it.
    by_digest = classes.groupBy("sha").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.sum("group_size").alias("rows")
    )
    by_digest = written(by_digest, "digests")
    keyed = written(rows.select("doc_id", "sha"), "keyed")
    found = spread_join(keyed, by_digest.filter("texts = 1"), ["sha"]).select("doc_id", "keep_id", "group_size", "sha")
    shared = by_digest.filter("texts > 1").select("sha")
    if not shared.isEmpty():  # different texts with one SHA-256 digest: match those rows on the text itself
        collided = rows.join(shared, "sha", "left_semi").select("doc_id", "sha", "norm")
        found = found.unionByName(collided.join(classes.select("sha", "norm", "keep_id", "group_size"), ["sha", "norm"]).drop("norm"))
    return _result(found)


def _result(found: DataFrame) -> DataFrame:
    shown = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return found.select(
        shown("doc_id").alias("doc_id"),
        shown("keep_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat id and text become one."""
    kept = exact_duplicates(docs, id_col, text_col, salts).filter("kept")
    kept = kept.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "__sha": F.sha2(normalised(F.col(text_col).cast("string")), 256)})
    return keyed.join(kept, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"]).drop("__id", "__sha")
