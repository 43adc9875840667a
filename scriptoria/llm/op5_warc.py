"""Query op5: all pages stored as WARC files in two replicas, one of them with injected damage, read back and audited."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import warc
from scriptoria.llm.common import Scratch, table


def damaged(html: Column, kind: Column) -> Column:
    """The injected faults of a payload: a byte overwritten at the start, or the second half lost."""
    flipped = F.concat(F.lit("#"), F.substring(html, 2, 1 << 30))
    return F.when(kind == 0, flipped).when(kind == 1, F.substring(html, F.lit(1), F.floor(F.char_length(html) / 2).cast("int"))).otherwise(html)


def records(pages: DataFrame, harmed: bool) -> DataFrame:
    """The records of a replica. The faults are drawn from the id's digest: 1 in 23 records altered, 1 in 101 cut
    short, 1 in 61 lost, and after 1 in 127 a record that the first replica does not have."""
    whole = warc.record(F.col("url"), F.col("page_id"), F.col("html"))
    if not harmed:
        return pages.select(whole.alias("value"))
    draw = F.conv(F.substring(F.sha2(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"), 256), 1, 6), 16, 10).cast("long")
    fault = F.when(draw % 23 == 0, 0).when(draw % 101 == 1, 1)
    value = F.when(draw % 61 == 2, F.lit("")).otherwise(warc.record(F.col("url"), F.col("page_id"), damaged(F.col("html"), fault)))
    added = F.when(draw % 127 == 3, F.concat(F.lit(warc.END), warc.record(F.col("url"), -F.col("page_id") - 1, F.lit("inserted")))).otherwise(F.lit(""))
    return pages.select(F.concat(value, added).alias("value"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, scratch, leaves = table(spark, sf_dir, "pages").select("page_id", "url", "html"), Scratch(spark, "warc"), []
    for harmed in (False, True):
        path = f"{scratch.folder}/replica-{int(harmed)}"
        warc.write_records(records(pages, harmed), path, "gzip")
        leaves.append(scratch.keep(warc.replica(spark, path)))
        scratch.remove(path)
    found = warc.audit(*leaves)
    page_id = F.regexp_extract("record_id", "<urn:x-page:(-?[0-9]+)>", 1)
    return found.select(
        F.when(page_id != "", page_id).cast("long").alias("page_id"), "status", (F.col("hi_a") - F.col("lo_a")).alias("length_a"), (F.col("hi_b") - F.col("lo_b")).alias("length_b"), "digest_a", "digest_b",
    )


ORACLE_SQL = """
WITH docs AS (
  SELECT page_id, coalesce(replace(replace(url, chr(13), ' '), chr(10), ' '), '') AS url, coalesce(html, '') AS html FROM pages
), faults AS (
  SELECT page_id, url, html, CAST('0x' || substr(sha256(coalesce(CAST(page_id AS VARCHAR), '')), 1, 6) AS BIGINT) AS c FROM docs
), both_sides AS (
  SELECT 'a' AS side, page_id, url, html FROM faults
  UNION ALL
  SELECT 'b', page_id, url, CASE WHEN c % 23 = 0 THEN '#' || substr(html, 2) WHEN c % 101 = 1 THEN substr(html, 1, CAST(floor(length(html) / 2) AS INTEGER)) ELSE html END FROM faults WHERE c % 61 <> 2
  UNION ALL
  SELECT 'b', -page_id - 1, url, 'inserted' FROM faults WHERE c % 127 = 3
), framed AS (
  SELECT side, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:x-page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Date: 2020-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR)
    || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM both_sides
), slim AS (
  SELECT side, page_id, CAST(strlen(rec) AS BIGINT) AS n, sha256(rec) AS digest FROM framed
)
SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'altered' END AS status,
  a.n AS length_a, b.n AS length_b, a.digest AS digest_a, b.digest AS digest_b
FROM (SELECT * FROM slim WHERE side = 'a') a FULL JOIN (SELECT * FROM slim WHERE side = 'b') b ON a.page_id = b.page_id
WHERE a.digest IS DISTINCT FROM b.digest
"""
