"""Helpers that the training-data operators share: shared-folder tables, row keys, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of the two word rules: anything but ASCII white space, and ASCII letters,
#: digits and everything from U+0080 on.
BLANKS = " \t\n\x0b\x0c\r"
SPACE_WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (local tests) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def few_files(df: DataFrame) -> DataFrame:
    """Deal rows that are small beside the work that made them into files whose number follows from
    the bytes: the planner merges the partitions of the exchange up to its advisory size. The stage
    that does the work then writes no files of its own, of which there would be one for each task."""
    return df.hint("rebalance")


def written(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage with copies that survive a lost executor, and gives the planner true sizes, so
    that a later join broadcasts only what is small. ``small``: by :func:`few_files`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (few_files(df) if small else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    free_shuffles(spark)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Words of 64 bits in the broadcast table of :func:`sieved`: never more rows than this, some 40 MB.
SIEVE_WORDS = 1 << 20


def sieved(df: DataFrame, keys: list[str], members: DataFrame) -> DataFrame:
    """``df`` with ``__maybe``: false only where no row of ``members`` has the same ``keys``.

    One bit for each hash of a member, in a broadcast table of a fixed size. Whoever joins by the
    keys then shuffles only the rows that may meet: all that do, and of the others a share that
    grows with the members (under 2 percent at a million of them, all of them at some hundred
    millions). Results do not depend on it.
    """

    def placed(rows):
        h = F.xxhash64(*keys)
        return rows.withColumn("__word", F.pmod(h, F.lit(SIEVE_WORDS))).withColumn("__bit", F.shiftright(h, 40).bitwiseAND(63).cast("int"))

    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bit"))
    bits = placed(members.select(*keys)).groupBy("__word").agg(F.bit_or(one).alias("__bits"))
    met = placed(df).join(F.broadcast(bits), "__word", "left")
    return met.withColumn("__maybe", F.coalesce(F.getbit("__bits", "__bit") == 1, F.lit(False))).drop("__word", "__bit", "__bits")


#: Keys that :func:`met_by_count` calls hot: those with more than one in so many of all rows.
HOT_KEYS = 1 << 16


def met_by_count(rows: DataFrame, counts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``counts``, which has each of its ``keys`` once and in ``size`` how many
    rows bear them. ``rows`` is a written table: it is counted and read twice.

    Keys with more than one in ``HOT_KEYS`` of the rows are fewer than ``HOT_KEYS``, however many
    rows there are: they are broadcast, and their rows stay where they are. The others are joined by
    shuffle, in which no key brings a task more than that share.
    """
    hot = F.col(size) * HOT_KEYS > rows.count()
    often = rows.join(F.broadcast(counts.filter(hot)), keys)
    seldom = rows.join(F.broadcast(counts.filter(hot).select(*keys)), keys, "left_anti").join(counts.filter(~hot), keys)
    return often.unionByName(seldom)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of finished steps."""
    spark._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that, faster, wherever no other capital stands."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def space_words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def count_space_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SPACE_WORD)).cast("long")


def count_alnum_words(text: Column) -> Column:
    """How many words :func:`alnum_words` finds; capitals need no lowering to be counted."""
    return F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long")


def alnum_words(text: Column) -> Column:
    """Runs of lower-case letters, digits and everything past ASCII, in a text of lower case."""
    return F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filtered_apart(df: DataFrame, names: tuple[str, ...], step) -> DataFrame:
    """``step(df)`` with the columns of ``df`` only: its own columns that bear the ``names`` the step
    adds are put aside meanwhile and come back as they were."""
    own = {c: f"__own_{c}" for c in df.columns if c in names}
    out = step(df.withColumnsRenamed(own)).drop(*names)
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*df.columns)


def row_hash(df: DataFrame, *first) -> Column:
    """A 64-bit hash of a row; columns that hold maps, which have no order, are left out."""
    return F.xxhash64(*first, *[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
