"""Derived inputs: SQL that Spark and DuckDB both run, over the tables ``pages`` and ``documents``.

The synthetic tables hold no documentation URLs and no Markdown, so these give the
operators something to decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

URLS = """
SELECT page_id,
  CASE page_id % 8 WHEN 0 THEN 'https://docs.' WHEN 1 THEN 'https://api.' WHEN 2 THEN 'https://www.' WHEN 3 THEN 'http://developers.'
    WHEN 4 THEN 'https://learn.' WHEN 5 THEN 'HTTPS://Docs.' WHEN 6 THEN 'https://help.' ELSE 'https://' END
  || 'site' || CAST(page_id % 13 AS STRING) || CASE page_id % 3 WHEN 0 THEN '.io' WHEN 1 THEN '.com' ELSE '.co.uk' END
  || CASE page_id % 11 WHEN 0 THEN ':8080' WHEN 1 THEN ':443' ELSE '' END
  || CASE page_id % 9 WHEN 0 THEN '/guide/intro' WHEN 1 THEN '/api/reference/' WHEN 2 THEN '/docs/v2/setup' WHEN 3 THEN '/documentation/swift'
    WHEN 4 THEN '/' WHEN 5 THEN '/org/project/docs/a.md' WHEN 6 THEN '/api' WHEN 7 THEN '/rest/v1/users' ELSE '' END
  || CASE page_id % 5 WHEN 0 THEN '?b=2&a=1&b=1' WHEN 1 THEN '#top' WHEN 2 THEN '?z=1#x' ELSE '' END AS url
FROM pages
UNION ALL SELECT -1, 'not-a-url'
UNION ALL SELECT -2, CAST(NULL AS STRING)
UNION ALL SELECT -3, 'http://localhost:3000'
"""

_FENCE = "chr(96) || chr(96) || chr(96)"
MARKDOWN = f"""
SELECT doc_id, source,
  '# ' || source || ' Guide' || chr(10) || coalesce(text, '') || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '## API Reference' || chr(10) || '- GET /api/items is an endpoint that needs an access token' || chr(10) || {_FENCE} || 'bash' || chr(10)
       || 'curl -X POST https://api.' || source || '.io/v1/items' || chr(10) || {_FENCE} || chr(10) ELSE '' END
  || CASE WHEN doc_id % 4 = 1 THEN '## Quick Start' || chr(10) || {_FENCE} || 'bash' || chr(10) || '$ npm install ' || source || chr(10) || {_FENCE} || chr(10)
       || '> Always pin the version of ' || source || ' you install.' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 = 2 THEN '### Overview of ' || source || chr(10) || 'This part explains what ' || source || ' is for and how its workflow and plugin settings are used in practice. More.' || chr(10) ELSE '' END
  || '## Notes' || chr(10) || '**Term' || CAST(doc_id % 5 AS STRING) || '**: a definition of the term used here' || chr(10)
  || 'Call ' || chr(96) || 'run(' || source || ')' || chr(96) || ' once' || chr(10) || 'Tip: keep the configuration of ' || source || ' under version control' || chr(10) AS md
FROM documents
"""

LINKS = """
SELECT CAST(p.page_id AS STRING) AS src, CAST((3 * p.page_id + 1) % n.n AS STRING) AS dst FROM pages p, (SELECT count(*) AS n FROM pages) n
UNION ALL SELECT CAST(p.page_id AS STRING), CAST((5 * p.page_id + 2) % n.n AS STRING) FROM pages p, (SELECT count(*) AS n FROM pages) n
"""

STORE = """
SELECT CASE WHEN doc_id % 3 = 0 THEN 'apis' ELSE 'tools' END AS category, source AS name, 'p' || CAST(doc_id AS STRING) || '.md' AS path, n_chars AS bytes,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '1' HOUR AS modified
FROM documents
"""


def corpus(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in ("pages", "documents"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)
