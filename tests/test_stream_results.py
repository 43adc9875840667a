"""Results of streams that are larger than the driver."""

import os
import subprocess
import sys

from scriptoria.plans import catalogue
from scriptoria.streaming import live as stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: A driver that takes 128 KB of results in all; 20000 rows are more.
SMALL_DRIVER = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from scriptoria.plans import catalogue
conf = {"spark.master": "local[2]", "spark.driver.maxResultSize": "128k", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setCheckpointDir(sys.argv[1] + "/shared")
e = F.col("id")
spark.range(20000).select(e.alias("event_id"), F.timestamp_seconds(e).cast("timestamp_ntz").alias("ts"), (e % 7).alias("user_id"), F.lit("view").alias("event_type"), F.rand(1).alias("value"), F.lit("").alias("props")).write.parquet(sys.argv[1] + "/events.parquet")
print("rows", catalogue.live_dedup_stream(spark, sys.argv[1]).count())
"""


def test_rows_of_a_stream_stay_off_the_driver(tmp_path):
    run = subprocess.run([sys.executable, "-c", SMALL_DRIVER, str(tmp_path)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert "rows 20000" in run.stdout, run.stderr[-2000:]
    assert not [f for f in (tmp_path / "shared").rglob("*") if f.is_file()], "work tables outlive the driver"


def test_stream_twice_and_without_rows(spark, sf_dir, tmp_path):
    first, second = (catalogue.live_dedup_stream(spark, sf_dir) for _ in range(2))
    assert first.count() == second.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert catalogue.live_dedup_stream(spark, str(tmp_path)).collect() == []
    (tmp_path / "none").mkdir()
    assert stream.run_to_files(spark.readStream.schema("a long").parquet(str(tmp_path / "none"))).collect() == []
