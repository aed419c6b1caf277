"""Hashes of word windows with built-in functions: the base of the scans.

A row's words are hashed once; hashes of longer windows are put together from shorter ones by
doubling, a pass over the row's array for each step. Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import alnum_words, lower_ascii


def words_of(text: Column) -> Column:
    """Lower-cased words of a text: letters, digits and everything past ASCII; null has none."""
    return alnum_words(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))))


def _shifted(a: Column, b: Column, by: int) -> Column:
    """Element i: the hash of a[i] and b[i + by]."""
    return F.zip_with(a, F.slice(b, F.lit(by + 1), F.size(b)), lambda x, y: F.xxhash64(x, y))


def with_window_hashes(df: DataFrame, words: str, outs: dict[int, str]) -> DataFrame:
    """Add, for each length in ``outs``, an array of that name with the hash of each window of so
    many words, by start; empty if none fits. All lengths share the steps of the doubling.

    Explode the arrays with an ``_outer`` form: the plain ones make Spark infer a filter on an
    array's size, which it pushes below the steps here and so computes them over again, many times.
    """
    df = df.withColumn("__h1", F.transform(words, lambda w: F.xxhash64(w)))
    have, power = {1: "__h1"}, 1
    while power * 2 <= max(outs):
        df = df.withColumn(f"__h{power * 2}", _shifted(F.col(have[power]), F.col(have[power]), power))
        power *= 2
        have[power] = f"__h{power}"
    for length in sorted(outs):
        made = 0
        for bit in range(length.bit_length()):
            part = 1 << bit
            if length & part and made + part not in have:
                df = df.withColumn(f"__h{made + part}", _shifted(F.col(have[made]), F.col(have[part]), made))
                have[made + part] = f"__h{made + part}"
            made += length & part
    for length, out in outs.items():
        whole = F.col(have[length])
        df = df.withColumn(out, F.slice(whole, F.lit(1), F.greatest(F.size(whole) - (length - 1), F.lit(0))))
    return df.drop(*have.values())


def row_keys(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that name a row by its content. Hashes pass over nulls, so what
    is null is hashed beside the values."""
    parts = [c.cast("string") for c in columns]
    null = [c.isNull() for c in columns]
    return F.xxhash64(*parts, *null), F.xxhash64(F.lit("second"), *reversed(parts), *null)


def row_names(df: DataFrame) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of whole rows; columns that hold maps are hashed as JSON."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields]
    mapped = ["map<" in f.dataType.simpleString() for f in df.schema.fields]
    values = [F.to_json(F.struct(c.alias("c"))) if m else c for c, m in zip(columns, mapped, strict=True)]
    null = [c.isNull() for c in columns]
    return F.xxhash64(*values, *null), F.xxhash64(F.lit("second"), *reversed(values), *null)


def one_of_each(named: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """One row (``columns``) for each pair (__r1, __r2) of ``wanted``, with the columns of ``wanted``.

    Rows of one name are equal. They are aggregated before they are shuffled for it, so that a row
    which repeats without end never meets itself in one task.
    """
    keys = ["__r1", "__r2"]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    met = named.join(wanted.select(*keys), keys).select(*keys, row.alias("__row"))
    return met.groupBy(*keys).agg(F.any_value("__row").alias("__row")).join(wanted, keys).select(*[c for c in wanted.columns if c not in keys], "__row.*")


def repeated(rows: DataFrame, times: str, copy: str, chunk: int = 10_000) -> DataFrame:
    """Every row ``times`` times, numbered from 0 in ``copy``; long runs are dealt to many tasks."""
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col(times) - 1) / chunk).cast("long")))
    # a fixed count: by their bytes the chunks, still short rows here, would be merged into one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.filter(F.col(times) > 0).withColumn("__chunk", chunks).filter(F.col("__chunk") * chunk < F.col(times)).repartition(parts)
    first = F.col("__chunk") * chunk
    return dealt.withColumn(copy, F.explode(F.sequence(first, F.least(first + chunk, F.col(times)) - 1))).drop("__chunk")
