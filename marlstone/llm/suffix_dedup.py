"""Removal of byte strings that repeat anywhere in a collection, by column-wise construction of the
collection's Burrows-Wheeler transform.

The anchor sieve (``anchors``) leaves fragments whose cores occur more than once, dealt to shards by
core. In a shard, fragments are the documents of a multi-document transform that grows by columns
from the right: each round puts one symbol in front of every fragment's suffix, moves the suffixes
by a stable sort of the column, and updates the common prefixes of neighbours by range minima.
Fragments are aligned at their anchors and windows of one length can only be equal at equal
distance from the anchor, so only suffixes that begin in the same column need an order among
themselves; a round reads the column before it and writes its own, front to back, to sequential
files that stay in memory up to a bound and then lie on the task's own disk without a name.

At the column of a window's start, neighbours with a common prefix of at least the window's length
are equal windows.
"""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.anchors import Symbols, gaps, keyed_texts, repeated_spans
from marlstone.llm.buffers import BYTE_CODES, Polynomial
from marlstone.llm.shared import few_files, table
from marlstone.llm.windows import row_keys

SPOOL_BYTES = 32_000_000


class ColumnFile:
    """A sequential file of one array: written front to back, then read front to back."""

    def __init__(self) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        self.dtype, self.count = np.int32, 0

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.truncate()
        self.file.write(memoryview(np.ascontiguousarray(values)).cast("B"))
        self.dtype, self.count = values.dtype, len(values)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.dtype, self.count)

    def close(self) -> None:
        self.file.close()


class ColumnTransform:
    """Burrows-Wheeler transform and common prefixes of aligned strings, column by column.

    ``group`` must not fall along the rows; suffixes are ordered within a group and have no common
    prefix across groups. The files hold the rows in suffix order and each row's common prefix with
    the row before it; the column that a round inserts, taken in suffix order, is the transform's
    next part.
    """

    def __init__(self, group: np.ndarray) -> None:
        self.group = group.astype(np.int64)
        self.order, self.prefix = ColumnFile(), ColumnFile()
        self.order.write(np.arange(len(group), dtype=np.int32))
        self.prefix.write(np.zeros(len(group), np.int32))

    def insert(self, column: np.ndarray) -> np.ndarray:
        """Put ``column[row]`` in front of every suffix; returns the transform's part."""
        order, prefix = self.order.read(), self.prefix.read()
        part = column[order]
        key = (self.group[order] << 8) | part
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        before, here = moved[:-1], moved[1:]
        same = key[1:] == key[:-1]
        common = np.zeros(len(order), np.int32)
        near = same & (here == before + 1)
        common[1:][near] = prefix[here[near]] + 1
        far = np.flatnonzero(same & ~near)
        if len(far):
            ranges = np.empty(2 * len(far), np.int64)
            ranges[::2], ranges[1::2] = before[far] + 1, here[far] + 1
            common[1 + far] = np.minimum.reduceat(np.append(prefix, np.int32(0)), ranges)[::2] + 1
        self.order.write(order[moved])
        self.prefix.write(common)
        return part

    def keep(self, rows: np.ndarray) -> None:
        """Drop the rows that are used up (``rows[row]`` false)."""
        order, prefix = self.order.read(), self.prefix.read()
        left = np.flatnonzero(rows[order])
        if len(left) == len(order):
            return
        common = np.zeros(len(left), np.int32)
        if len(left) > 1:
            # the least common prefix on the way from one kept row to the next
            common[1:] = np.minimum.reduceat(prefix[: left[-1] + 1], left[:-1] + 1)
        self.order.write(order[left])
        self.prefix.write(common)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        return self.order.read(), self.prefix.read()

    def close(self) -> None:
        self.order.close()
        self.prefix.close()


def repeated_windows(pieces: list[bytes], core: np.ndarray, least: np.ndarray, most: np.ndarray, times: np.ndarray, length: int, reach: int) -> np.ndarray:
    """Flags (fragment, distance to the anchor) of windows that equal another fragment's window."""
    n = len(pieces)
    grid = np.zeros((reach - 1 + length, n), np.uint8)  # a row for each column of the transform
    for i, piece in enumerate(pieces):
        start = reach - 1 - int(most[i])
        grid[start : start + len(piece), i] = np.frombuffer(piece, np.uint8)
    group = np.cumsum(np.concatenate([[0], (core[1:] != core[:-1]).astype(np.int64)]))
    weight = np.minimum(times, 2)
    flags = np.zeros((n, reach), bool)
    transform = ColumnTransform(group)
    # from the last column down to the anchor's: the core's own symbols are compared like any others
    for column in range(reach - 2 + length, reach - 2, -1):
        transform.insert(grid[column])
    for x in range(reach):
        if x:
            transform.keep(most >= x)
            transform.insert(grid[reach - 1 - x])
        order, common = transform.read()
        if not len(order):
            break
        active = least[order] <= x
        heads = np.flatnonzero(common < length)  # the first row has no common prefix
        found = np.add.reduceat(np.where(active, weight[order], 0), heads)
        runs = np.diff(np.append(heads, len(order)))
        flags[order, x] = active & np.repeat(found > 1, runs)
    transform.close()
    return flags


def read_bytes(buffer: np.ndarray, offsets: np.ndarray) -> Symbols:
    at = np.arange(len(buffer) + 1)
    return Symbols(Polynomial(BYTE_CODES[buffer]), offsets, buffer, at[:-1], at[1:])


def remove_repeats(df: DataFrame, length: int = 400, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add ``spans`` (byte begin and end of the removed runs) and ``kept`` (the other bytes).

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same
    or another text, overlaps included; strings never cross texts. Null texts are empty; texts
    shorter than ``length`` stay whole. Of equal rows each is another's repeat. Columns named spans
    or kept are replaced.
    """
    reach = max(2, length * 5 // 8)
    gram = min(16, length - reach + 1)

    def index(pieces, core, least, most, times):
        return repeated_windows(pieces, core, least, most, times, length, reach)

    df = df.drop("spans", "kept")
    spans = repeated_spans(keyed_texts(df, key, text), read_bytes, index, length, reach, gram)
    k1, k2 = row_keys(F.col(key), F.col(text))
    raw = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    out = df.withColumn("__k1", k1).withColumn("__k2", k2).join(spans.withColumnRenamed("k1", "__k1").withColumnRenamed("k2", "__k2"), ["__k1", "__k2"], "left").drop("__k1", "__k2")
    out = out.withColumn("__raw", raw).withColumn("__n", F.octet_length("__raw"))
    pieces = F.transform(gaps(F.col("spans"), F.col("__n")), lambda g: F.substring(F.col("__raw"), g["begin"] + 1, g["end"] - g["begin"]))
    kept = F.when(F.col("spans").isNull(), F.col("__raw")).otherwise(F.aggregate(pieces, F.lit(b""), lambda a, b: F.concat(a, b)))
    return out.withColumn("kept", kept).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>"))).drop("__raw", "__n")


def op3_column_transform(spark, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings cut out of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    digest = remove_repeats(docs).select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    return few_files(digest)
