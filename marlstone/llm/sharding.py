"""Rendezvous (highest random weight) sharding of stable record keys.

Every shard draws a score for every key from a hash of both; the key goes to the shard with the
best score. With weight w the score is -ln(u) / w for a uniform u, and the least score wins, so a
shard wins in proportion to its weight. Adding a shard can only move keys into the new shard, and
removing one only moves the keys it had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import few_files, table, text_or_empty, written
from marlstone.llm.windows import one_of_each, repeated, row_names

_BITS = 52


def _uniform(key: Column, shard: int) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, _BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def best_draw(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """The best (score, shard) of a string key over the shards from ``first`` on.

    Ties of scores go to the smaller shard. Weights must be positive. With equal weights the draws
    are compared as integers, so no rounding enters.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    if set(weights) == {1.0}:
        scores = [-_uniform(key, first + s) for s in range(len(weights))]
    else:
        scores = [-F.log((_uniform(key, first + s) + F.lit(0.5)) / F.lit(float(2**_BITS))) / F.lit(float(w)) for s, w in enumerate(weights)]
    return F.array_min(F.array(*[F.struct(v.alias("score"), F.lit(first + s).alias("shard")) for s, v in enumerate(scores)]))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number (0 to len(weights) - 1) of a string key."""
    return best_draw(key, weights)["shard"]


def key_of(name: str) -> Column:
    """The stable key of a record: its id as text; null ids share the key ``null``."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def shard_records(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, rows_per_bin: int = 20_000, grown: bool = False) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within a shard), and with ``grown`` also
    ``grown_shard``: where the key goes if there is one more shard of weight 1, for which only one
    more draw is made (all weights are 1 then).

    Slots are worked out on names of rows: equal rows are counted, names are dealt into bins of about
    ``rows_per_bin``, the bins' sums give offsets (shards x bins rows), and names are numbered inside
    a bin. So neither a shard nor a key or a row that repeats without end meets in one task. Rows
    that repeat get as many slots as there are of them. An empty table gives no rows; a null key is a
    key. Columns with the names of the results are replaced.
    """
    names = ["shard", "slot", "grown_shard"] if grown else ["shard", "slot"]
    df = df.drop(*names)
    if grown and set(weights) != {1.0}:
        raise ValueError("a grown shard is drawn among equal weights")
    r1, r2 = row_names(df)
    named = df.withColumn("__r1", r1).withColumn("__r2", r2)
    drawn = named.select("__r1", "__r2", best_draw(key_of(key), weights).alias("__best"), *([best_draw(key_of(key), [1.0], len(weights)).alias("__more")] if grown else []))
    target = [F.col("__best.shard").alias("shard"), *([F.least("__best", "__more")["shard"].alias("grown_shard")] if grown else [])]
    extra = names[2:]
    rows = drawn.select("__r1", "__r2", *target).groupBy("__r1", "__r2", "shard", *extra).agg(F.count(F.lit(1)).alias("__n"))
    rows = written(rows, "row-names")
    bins = max(8, -(-rows.count() // (rows_per_bin * len(weights))))
    binned = rows.withColumn("__bin", F.pmod("__r1", F.lit(bins)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.groupBy("shard", "__bin").agg(F.sum("__n").alias("__k")).withColumn("__from", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    inside = Window.partitionBy("shard", "__bin").orderBy("__r1", "__r2").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(offsets, ["shard", "__bin"])
    placed = placed.select("__r1", "__r2", "shard", *extra, "__n", (F.col("__from") + F.col("__in")).cast("long").alias("slot"))
    out = named.join(placed.filter("__n = 1"), ["__r1", "__r2"]).select(*df.columns, *names)
    if rows.filter("__n > 1").isEmpty():
        return out
    again = repeated(one_of_each(named, placed.filter("__n > 1"), df.columns), "__n", "__copy")
    return out.unionByName(again.withColumn("slot", F.col("slot") + F.col("__copy")).select(*df.columns, *names))


def op7_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 16 equal shards by doc_id, and where a 17th shard would move them."""
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    digest = shard_records(docs, grown=True).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )
    return few_files(digest)


def shard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document gets its shard and slot."""
    return shard_records(docs)

