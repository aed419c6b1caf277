"""Incremental ingestion: a stream of page files, parsed and merged by key into a published table.

The checkpoint remembers which files are done, so a run that was stopped goes on where it was; a
batch that is replayed gives the same table, because merging is by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.ingest import merge_staged, parse_products, stage
from marlstone.sources.tables import publish, read_published

PAGES = "url string, html string, retrieved_at string, seq long"
STAGED = ("source_product_key", "name", "category", "subcategory", "sku", "price", "url", "image", "content_sha256", "retrieved_at", "seq")


def staged_products(pages: DataFrame, source_id: str) -> DataFrame:
    """Products of a batch of pages, the last of every key. A page may come in several versions: each
    product keeps the time and number of the version it was read from."""
    rows = stage(parse_products(pages), source_id, F.col("retrieved_at")).select(*STAGED)
    return merge_staged(rows.limit(0), rows)


def ingest_stream(spark: SparkSession, pages_dir: str, table_path: str, checkpoint: str, source_id: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Start ingesting all page files that are there (Parquet with PAGES), then stop."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(pages_dir)

    def merge(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        new = staged_products(batch, source_id)
        path = session._jvm.org.apache.hadoop.fs.Path(f"{table_path}/CURRENT")
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            new = merge_staged(read_published(session, table_path), new)
        publish(new, table_path)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by type and window, late ones up to a bound."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
