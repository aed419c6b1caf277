"""Removal of word sequences that repeat anywhere in a collection, by FM-indexes per shard.

The anchor sieve (``anchors``) leaves fragments whose cores occur more than once, dealt to shards by
core. Each shard builds a compressed FM-index of its fragments: the Burrows-Wheeler transform of
their words, in a wavelet matrix of packed bits with counts by machine word. The fragments are then
streamed against the index: backward search from the end of a window, all fragments in step, gives
how far the words match at least two places (their matching statistic, capped at the window's
length). A window is reported if the statistic reaches its length; where it stops short, no window
over the same words can reach it, so the search goes on behind the stop.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.anchors import Symbols, gaps, keyed_texts, repeated_spans
from marlstone.llm.buffers import Polynomial, inner_places, runs_of_bytes, word_codes, words
from marlstone.llm.shared import few_files, space_words, table
from marlstone.llm.windows import row_keys


class BitRank:
    """Packed bits with the number of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        self.words = np.packbits(np.pad(bits, (0, 64 - len(bits) % 64)), bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Rank of any symbol in a sequence of small integers, one bit vector for each binary digit."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            rank = BitRank(bits.astype(np.uint8))
            zeros = len(symbols) - int(bits.sum())
            self.levels.append((shift, rank, zeros))
            symbols = symbols[np.argsort(bits, kind="stable")]

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of ``symbol`` before ``low`` and before ``high``."""
        start = np.zeros_like(low)
        for shift, rank, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b, c = rank.ones(start), rank.ones(low), rank.ones(high)
            start = np.where(one, zeros + a, start - a)
            low = np.where(one, zeros + b, low - b)
            high = np.where(one, zeros + c, high - c)
        return low - start, high - start


def suffix_array(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, by doubling, equal up to ``longest`` symbols at most."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    have, n = 1, len(symbols)
    order = np.argsort(rank, kind="stable")
    while have < longest:
        after = np.zeros(n, np.int64)
        after[: n - have] = rank[have:] + 1 if have < n else 0
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        have *= 2
    return order


class FMIndex:
    """Backward search over texts of integer symbols (1 and up), each ended by a mark 0."""

    def __init__(self, texts: list[np.ndarray], sigma: int) -> None:
        joined = np.concatenate([np.append(t, 0) for t in texts])
        order = suffix_array(joined, max(len(t) for t in texts) + 1)
        last = joined[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(joined, minlength=sigma))])
        self.matrix = WaveletMatrix(last, sigma)
        self.size = len(joined)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put in front."""
        a, b = self.matrix.ranks(symbol, low, high)
        return self.first[symbol] + a, self.first[symbol] + b


def word_numbers(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 1 on, equal if and only if the words' bytes are, and one more than the greatest.

    Words are grouped by their codes and then compared byte for byte with the first of their group;
    should a code stand for two words, a dictionary of the words themselves numbers them.
    """
    known, first, ids = np.unique(word_codes(buffer, starts, ends), return_index=True, return_inverse=True)
    size, model = ends - starts, first[ids]
    same = (size == size[model]).all()
    for run in runs_of_bytes(size) if same else ():
        inner = inner_places(size[run])
        here, there = (np.repeat(x[run], size[run]) for x in (starts, starts[model]))
        same = same and (buffer[inner + here] == buffer[inner + there]).all()
    if same:
        return ids.astype(np.int64) + 1, len(known) + 1
    raw, numbers = buffer.tobytes(), {}
    out = np.array([numbers.setdefault(raw[a:b], len(numbers) + 1) for a, b in zip(starts, ends, strict=True)], np.int64)
    return out, len(numbers) + 1


def repeated_windows(pieces: list[bytes], core: np.ndarray, least: np.ndarray, most: np.ndarray, times: np.ndarray, length: int, reach: int) -> np.ndarray:
    """Flags (fragment, distance to the anchor) of windows found twice or more in the shard.
    ``pieces``: words joined by a blank."""
    n = len(pieces)
    buffer = np.frombuffer(b"".join(pieces), np.uint8)
    starts, ends, firsts = words(buffer, np.cumsum([0, *(len(p) for p in pieces)]))
    ids, sigma = word_numbers(buffer, starts, ends)
    sizes = np.diff(firsts)
    begin = np.cumsum(sizes) - sizes
    texts = [ids[b : b + s] for b, s in zip(begin, sizes, strict=True)]
    # a fragment found twice or more counts as two
    index = FMIndex([*texts, *(t for t, k in zip(texts, times, strict=True) if k > 1)], sigma)
    flags = np.zeros((n, reach), bool)
    queries = np.flatnonzero(times < 2)
    start, at = np.zeros(len(queries), np.int64), np.full(len(queries), length, np.int64)
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), index.size, np.int64)
    base, windows, last_x = begin[queries], sizes[queries] - length + 1, most[queries]
    while len(queries):
        at -= 1
        low, high = index.extend(ids[base + at], low, high)
        failed, met = high - low < 2, at == start
        good = met & ~failed
        flags[queries[good], last_x[good] - start[good]] = True
        move = failed | good
        # the statistic stopped at ``at``: windows that begin up to there hold the same words
        start[move] = at[move] + 1
        at[move] = start[move] + length
        low[move], high[move] = 0, index.size
        left = start < windows
        if not left.all():
            queries, start, at, low, high, base, windows, last_x = (v[left] for v in (queries, start, at, low, high, base, windows, last_x))
    return flags


def read_words(buffer: np.ndarray, offsets: np.ndarray) -> Symbols:
    """The words of the texts, spelt with one blank behind each."""
    starts, ends, firsts = words(buffer, offsets)
    size = ends - starts
    last = np.cumsum(size + 1)
    data = np.full(int(last[-1]) if len(last) else 0, 32, np.uint8)
    inner = inner_places(size)
    data[inner + np.repeat(last - size - 1, size)] = buffer[inner + np.repeat(starts, size)]
    return Symbols(Polynomial(word_codes(buffer, starts, ends) | np.uint64(1)), firsts, data, last - size - 1, last - 1)


def remove_repeats(df: DataFrame, length: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add ``n_words``, ``spans`` (first word and end of removed runs) and ``kept`` (the other words,
    joined by one blank).

    A word goes if a sequence of ``length`` words that covers it starts anywhere else too, in the
    same or another text. Words are runs of anything but ASCII white space, compared unchanged: the
    index compares their bytes, and fragments that repeat as a whole a cryptographic hash of them.
    Null texts have no words; texts of fewer words stay whole. Of equal rows each is another's
    repeat. Columns with the names of the results are replaced.
    """
    reach = max(2, length * 2 // 3)
    gram = min(2, length - reach + 1)

    def index(pieces, core, least, most, times):
        return repeated_windows(pieces, core, least, most, times, length, reach)

    df = df.drop("n_words", "spans", "kept")
    spans = repeated_spans(keyed_texts(df, key, text), read_words, index, length, reach, gram)
    k1, k2 = row_keys(F.col(key), F.col(text))
    out = df.withColumn("__k1", k1).withColumn("__k2", k2).join(spans.withColumnRenamed("k1", "__k1").withColumnRenamed("k2", "__k2"), ["__k1", "__k2"], "left").drop("__k1", "__k2")
    out = out.withColumn("__w", space_words(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    out = out.withColumn("n_words", F.size("__w"))
    left = F.flatten(F.transform(gaps(F.col("spans"), F.col("n_words")), lambda g: F.slice(F.col("__w"), g["begin"] + 1, g["end"] - g["begin"])))
    kept = F.array_join(F.when(F.col("spans").isNull(), F.col("__w")).otherwise(left), " ")
    return (
        out.withColumn("kept", kept)
        .withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")))
        .withColumn("n_words", F.col("n_words").cast("long"))
        .drop("__w")
    )


def op6_fm_index(spark, sf_dir: str) -> DataFrame:
    """Repeated sequences of 35 words cut out of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = remove_repeats(docs).select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    return few_files(digest)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g FROM starts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM again)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS t, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j WHERE g.j IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
