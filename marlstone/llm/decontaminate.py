"""Benchmark decontamination with built-in functions only.

The normalised word windows of the benchmark make a hash set, which is broadcast to the scan if its
counted size is under a bound (beyond it Spark joins by shuffling). Every window of every
document is looked up, windows of all lengths that the benchmark has (items may be shorter than a
window); hits are then verified word for word, and the covered words give spans to cut out or
documents to drop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import count_alnum_words, few_files, filtered_apart, table, text_or_empty, written
from marlstone.llm.windows import row_keys, with_window_hashes, words_of

#: Most distinct window hashes that are broadcast: about 60 bytes each once hashed, 60 MB in all.
BROADCAST_HASHES = 1_000_000

#: Columns that :func:`contamination` adds.
FIGURES = ("n_words", "n_hit", "item_ids", "hit_words")


def benchmark_windows(items: DataFrame, item: str, text: str, length: int) -> DataFrame:
    """Distinct windows (``hash``, ``length``, ``window`` words joined by blanks) with their items.

    An item of fewer words than ``length``, but not none, is one window; null texts give none.
    """
    words = items.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    starts = words.withColumn("length", F.least(F.col("n"), F.lit(length))).select(
        "item", "words", "length", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("length") + 1)).alias("start")
    )
    cut = starts.select("item", "length", F.slice("words", F.col("start"), F.col("length")).alias("words"))
    return cut.groupBy("length", "words").agg(F.collect_set("item").alias("items"))


def _hashed(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Windows with the hash that :func:`with_window_hashes` gives them."""
    parts = [with_window_hashes(windows.filter(F.col("length") == n), "words", {n: "__x"}).withColumn("hash", F.col("__x")[0]).drop("__x") for n in lengths]
    return reduce(DataFrame.unionByName, parts).withColumn("window", F.array_join("words", " ")).drop("words")


def _window_at(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def _places(keyed: DataFrame, lengths: list[int], *more: str) -> DataFrame:
    """Every window of the texts: k1, k2, length, start, hash (and the columns ``more``)."""
    names = {n: f"__x{n}" for n in lengths}
    rows = with_window_hashes(keyed.withColumn("__w", words_of(F.col("__text"))), "__w", names)
    if len(lengths) == 1:
        return rows.select("k1", "k2", *more, F.lit(lengths[0]).alias("length"), F.posexplode_outer(names[lengths[0]]).alias("start", "hash"))
    by_length = F.array(*[F.struct(F.lit(n).alias("length"), F.col(x).alias("hashes")) for n, x in names.items()])
    sets = rows.select("k1", "k2", *more, F.explode_outer(by_length).alias("s"))
    return sets.select("k1", "k2", *more, "s.length", F.posexplode_outer("s.hashes").alias("start", "hash"))


def _scan(keyed: DataFrame, hashes: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits by a broadcast hash set. The words of a row go along by reference as its windows pass
    the set, and only those of a hit are written. Each length has a scan of its own: one scan that
    nests the lengths copies a row's words for each of them and took twice the time."""
    places = reduce(DataFrame.unionByName, [_places(keyed, [n], "__w") for n in lengths])
    hits = places.join(F.broadcast(hashes), "hash", "left_semi")
    return hits.select("k1", "k2", "start", "length", "hash", _window_at("__w", F.col("start"), F.col("length")).alias("window"))


def _scan_by_shuffle(keyed: DataFrame, hashes: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark too large to broadcast: hashes are joined by shuffle, and the texts
    of rows with hits are fetched once more for their words."""
    hits = written(_places(keyed, lengths).join(hashes, "hash", "left_semi").distinct(), "hash-hits")
    by_row = written(hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "length", "hash")).alias("places")), "hash-hit-rows", small=True)
    worded = keyed.join(by_row, ["k1", "k2"]).withColumn("__w", words_of(F.col("__text")))
    named = F.transform(
        "places", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), p["hash"].alias("hash"), _window_at("__w", p["start"], p["length"]).alias("window"))
    )
    return worded.select("k1", "k2", F.explode_outer(named).alias("p")).select("k1", "k2", "p.*")


def find_hits(docs: DataFrame, windows: DataFrame, lengths: list[int], text: str, keys: tuple[Column, Column]) -> DataFrame:
    """(k1, k2, start, length, items): verified places of benchmark windows in the documents."""
    hashes = windows.select("hash").distinct()
    scan = _scan if hashes.count() <= BROADCAST_HASHES else _scan_by_shuffle
    keyed = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), F.col(text).alias("__text"))
    hits = written(scan(keyed, hashes, lengths), "hits", small=True)
    # The hash only nominates: the words themselves must be equal.
    return hits.distinct().join(windows, ["length", "hash", "window"]).select("k1", "k2", "start", "length", "items")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    benchmark_text: str = "text",
    key: str = "doc_id",
    length: int = 13,
) -> DataFrame:
    """Add n_words, n_hit (words inside a hit window), item_ids (sorted) and spans of hit words.

    Null texts have no words. An empty benchmark hits nothing; an empty table stays empty. Rows that
    are equal in key and text get equal results. The figures replace columns of the same names.
    """
    docs = docs.drop(*FIGURES)
    windows = benchmark_windows(benchmark, item, benchmark_text, length)
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    keys = row_keys(F.col(key), F.col(text))
    counted = docs.withColumn("n_words", count_alnum_words(text_or_empty(text)))
    if not lengths:
        none = F.array().cast("array<string>")
        return counted.withColumn("n_hit", F.lit(0).cast("long")).withColumn("item_ids", none).withColumn("hit_words", F.array().cast("array<int>"))
    windows = written(_hashed(windows, lengths), "windows", small=True)
    hits = find_hits(docs, windows, lengths, text, keys)
    per_row = written(
        hits.groupBy("k1", "k2").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))))).alias("hit_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
        ),
        "hit-rows", small=True
    )
    joined = counted.withColumn("__k1", keys[0]).withColumn("__k2", keys[1]).join(
        per_row.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "hit_words", "item_ids"), ["__k1", "__k2"], "left"
    )
    return (
        joined.withColumn("n_hit", F.coalesce(F.size("hit_words"), F.lit(0)).cast("long"))
        .withColumn("n_hit", F.greatest(F.col("n_hit"), F.lit(0).cast("long")))
        .withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
        .withColumn("hit_words", F.coalesce("hit_words", F.array().cast("array<int>")))
        .drop("__k1", "__k2")
    )


def contaminated(share: int = 20) -> Column:
    """At least one hit word, and at least one word in ``share``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Cut hit words out: ``clean_text`` is the text without them, all between words kept as it is.

    Takes what :func:`contamination` returns. Rows without hits keep their text.
    """
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # words, capitals included
    value = text_or_empty(text)
    between, words = F.split(value, word, -1), F.regexp_extract_all(value, F.lit(word), F.lit(0))
    out = found.withColumn("__b", between).withColumn("__w", words).withColumn("__n", F.size("__w"))
    kept = F.transform("__w", lambda w, i: F.when(F.array_contains(F.col("hit_words"), i.cast("int")), F.lit("")).otherwise(w))
    glued = F.array_join(F.zip_with("__b", kept, lambda b, w: F.concat(b, F.coalesce(w, F.lit("")))), "")
    return out.withColumn("clean_text", F.when(F.col("n_hit") > 0, glued).otherwise(F.col(text))).drop("__b", "__w", "__n")


def op5_benchmark_windows(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    figures = found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
    return few_files(figures)


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    benchmark = table(spark, sf_dir, "benchmark")
    return filtered_apart(docs, FIGURES, lambda d: contamination(d, benchmark).filter(~contaminated()))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bi AS (
  SELECT item, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM bi
), ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n
), dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM di
), hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
