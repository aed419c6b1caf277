"""Sources and sinks: tolerant JSON, versioned tables with an atomic pointer, upserts, snapshots."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array or object file of a fixed schema, with or without a byte order mark; a missing
    file is an empty table."""
    fs, p = _filesystem(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def with_order(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Number the rows of a file in their order (for files small enough to be read by one task, as
    multi-line JSON is)."""
    return rows.withColumn(order, F.monotonically_increasing_id())


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder of ``spark.checkpoint.dir`` (a temporary one where it is unset) and
    read back: cuts lineage with copies that outlive an executor."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, path: str, status: str = "complete") -> str:
    """Write a new version under ``path`` and then move the pointer to it in one rename: a reader
    sees the old version or the new one, never a part. Returns the version."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    fs, _ = _filesystem(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fresh, live = hadoop.Path(f"{path}/CURRENT.{version}"), hadoop.Path(f"{path}/CURRENT")
    out = fs.create(fresh, True)
    out.write(bytearray(f"{version} {status}".encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, live, options)
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names."""
    version = spark.read.text(f"{path}/CURRENT").first()[0].split(" ")[0]
    return spark.read.parquet(f"{path}/versions/{version}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Insert or replace by key: rows of ``new`` win over ``old``; among them the last by ``order``."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    latest = [F.desc("_batch"), *([F.desc(order)] if order else [])]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*latest))
    return both.withColumn("_r", rank).filter("_r = 1").drop("_r", "_batch")


def fingerprint(df: DataFrame) -> str:
    """Hash of a table's rows that does not depend on their order, but counts repeats."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    digest = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("s"), F.bit_xor(F.xxhash64(text)).alias("x")).first()
    return f"{row['n']}-{row['s'] or 0}-{(row['x'] or 0) & (2**64 - 1):016x}"


def snapshot_name(sku, content):
    """File name of a page's raw snapshot: a safe form of the sku and the content's hash."""
    return F.concat(F.regexp_replace(sku, "[^A-Za-z0-9_-]+", "_"), F.lit("_"), F.substring(F.sha2(content, 256), 1, 12), F.lit(".html.gz"))


def write_lines(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Text sink of one string column, in the rows' order."""
    writer = df.write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).text(path)


def type_corpus(products: DataFrame, scope: DataFrame, per_type: int = 8) -> DataFrame:
    """(product_type_id, text): a section on each type in scope, with its count and first examples."""
    named = products.join(scope, "product_type_id")
    rank = F.row_number().over(Window.partitionBy("product_type_id").orderBy("ord"))
    lines = named.withColumn("_r", rank).filter(F.col("_r") <= per_type)
    line = F.concat(F.lit("- "), "name", F.lit(" (SKU: "), F.coalesce("sku", F.lit("None")), F.lit(")"))
    examples = lines.groupBy("product_type_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))), lambda x: x["l"]).alias("examples"))
    counts = named.groupBy("product_type_id").agg(F.count(F.lit(1)).alias("n"))
    joined = scope.join(counts, "product_type_id", "left").join(examples, "product_type_id", "left").fillna({"n": 0})
    head = F.concat(F.lit("## "), "product_type_id"), F.concat(F.lit("Product count: "), F.col("n").cast("string"))
    return joined.select("product_type_id", F.concat_ws("\n", *head, F.lit("Examples:"), F.concat_ws("\n", "examples")).alias("text"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def write_index(phrases: DataFrame, path: str) -> None:
    """Entity index in a folder for each entity type, so that a lookup of one type reads only its own."""
    phrases.write.partitionBy("entity_type").parquet(path)


def read_index(spark: SparkSession, path: str, entity_type: str | None = None) -> DataFrame:
    index = spark.read.parquet(path)
    return index if entity_type is None else index.filter(F.col("entity_type") == entity_type)
