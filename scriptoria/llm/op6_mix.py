"""Query op6: every document's place in the mix of sources."""

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm import pfair
from scriptoria.llm.common import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.mix(docs).select("doc_id", "source", "block", "slot", "release", "deadline")


ORACLE_SQL = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS digest FROM documents
), counts AS (
  SELECT key, count(*) AS n FROM rows_ GROUP BY key
), total AS (
  SELECT sum(sqrt(n)) AS t FROM counts
), weights AS (
  SELECT row_number() OVER (ORDER BY key) AS i, key, greatest(1, CAST(floor(1000 * sqrt(n) / t + 0.5) AS BIGINT)) AS a FROM counts, total
), fixed AS (
  SELECT list(a ORDER BY i) AS a, CAST(sum(a) AS BIGINT) AS p, CAST(count(*) AS BIGINT) AS s FROM weights
), sim AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS j, CAST(0 AS BIGINT) AS pick, a, p, s FROM fixed
  UNION ALL
  SELECT t, list_transform(range(1, s + 1), lambda i: CASE WHEN i = pick THEN j[i] + 1 ELSE j[i] END), pick, a, p, s FROM (
    SELECT t + 1 AS t, j, a, p, s,
      list_min(list_transform(list_filter(range(1, s + 1), lambda i: j[i] < a[i] AND (j[i] * p) // a[i] <= t + 1), lambda i: (((j[i] + 1) * p + a[i] - 1) // a[i]) * 1000000 + i)) % 1000000 AS pick
    FROM sim WHERE t + 1 < p
  )
), slots AS (
  SELECT t, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM sim WHERE t >= 0
), placed AS (
  SELECT doc_id, source, key, CAST(floor((row_number() OVER (PARTITION BY key ORDER BY digest, doc_id) - 1) / 8) AS BIGINT) AS block FROM rows_
)
SELECT d.doc_id, d.source, d.block, (d.block // w.a) * f.p + x.t AS slot, (d.block * f.p) // w.a AS release, ((d.block + 1) * f.p + w.a - 1) // w.a AS deadline
FROM placed d JOIN weights w ON d.key = w.key JOIN slots x ON x.pick = w.i AND x.k = d.block % w.a, fixed f
"""
