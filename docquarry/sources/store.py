"""The document store: a partitioned Parquet table, and import and export of Markdown trees.

Table columns: category, name (partitions), path, url, title, content, bytes, modified.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "path string, url string, title string, content string, bytes long, modified timestamp, category string, name string"


def documentation_path(base: str, category: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit(base), category, name)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


file_exists = _exists


def read_markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, content, bytes, modified) of every Markdown file at any depth; a missing folder is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "path string, content string, bytes long, modified timestamp")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreMissingFiles", "true").text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified")
    )


def write_store(docs: DataFrame, path: str) -> None:
    """Write or replace the partitions that ``docs`` holds."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category", "name").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(path) if _exists(spark, path) else spark.createDataFrame([], COLUMNS)


def delete_documentation(spark: SparkSession, path: str, category: str, name: str) -> None:
    """Drop one documentation set; silent where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/category={category}/name={name}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def frontmatter(title: Column, url: Column, date: Column, category: Column, tool: Column, content: Column) -> Column:
    """Markdown with its five quoted keys in front, on lines of their own."""
    quoted = lambda key, c: F.concat(F.lit(f'{key}: "'), F.coalesce(c, F.lit("")), F.lit('"'))
    lines = [F.lit("---"), quoted("title", F.replace(title, F.lit('"'), F.lit('\\"'))), quoted("url", url), quoted("date", date), quoted("category", category), quoted("tool", tool), F.lit("---"), F.lit(""), content]
    return F.concat_ws("\n", *lines)


def export_markdown(docs: DataFrame, base: str) -> None:
    """One file per row at base/category/name/path, written by the executors; on a cluster ``base`` must be mounted on all of them."""
    import os

    def write(rows: Iterator) -> None:
        for r in rows:
            parts = [x for x in r.path.split("/") if x not in ("", ".", "..")]  # inside its folder, nested as stored
            to = os.path.join(base, r.category, r.name, *parts)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "w", encoding="utf-8") as f:
                f.write(r.content)

    docs.select("category", "name", "path", "content").foreachPartition(write)


# ---------------------------------------------------------------- catalog


def list_documentation(store: DataFrame, category: str | None = None) -> DataFrame:
    rows = store.filter(F.col("category") == category) if category else store
    return rows.select("category", "name").distinct()


def documentation_stats(store: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(category, name, file_count, total_size, last_modified); sets in ``wanted`` that the store lacks count zero."""
    stats = store.groupBy("category", "name").agg(F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_size"), F.max("modified").alias("last_modified"))
    if wanted is None:
        return stats
    return wanted.join(stats, ["category", "name"], "left").select("category", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("file_count", "total_size")], "last_modified")


def catalog_lines(stats: DataFrame) -> DataFrame:
    """(category, name, line): the listing's lines."""
    kilobytes = F.round(F.col("total_size") / 1024).cast("long").cast("string")
    updated = F.coalesce(F.concat(F.lit(", updated "), F.date_format("last_modified", "M/d/yyyy")), F.lit(""))
    line = F.concat(F.lit("   📄 "), F.col("name"), F.lit(" ("), F.col("file_count").cast("string"), F.lit(" files, "), kilobytes, F.lit("KB"), updated, F.lit(")"))
    return stats.select("category", "name", line.alias("line"))


def catalog_totals(store: DataFrame) -> DataFrame:
    """Extension: totals by name, category and overall."""
    return store.rollup("category", "name").agg(F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_size"))
