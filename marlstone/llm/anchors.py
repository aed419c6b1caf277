"""Exact sieve for repeated windows of a fixed length, for bytes and for words.

A window of ``length`` symbols is tied to its anchor: the place of the least gram hash among the
first ``reach`` grams that begin in it (the last of equal ones). The anchor depends on the window's
own symbols only, so equal windows have their anchors at the same distance from their starts. The
windows tied to one anchor start within ``reach`` symbols before it, and all of them hold the
anchor's core: the ``length - reach + 1`` symbols from the anchor on. So a window can only be
repeated if the core's hash is found twice, which most cores' hashes are not: the sieve drops those
and loses nothing. An anchor's fragment is the union of its windows; each window of a text lies in
exactly one fragment. If a whole fragment repeats (same core, same extent, same digest of its
bytes), all its windows repeat. What is left - cores found twice with fragments that differ - goes
on to an operator's own index, which compares symbols.

Classes (equal cores) can hold any share of the rows. Equal fragments are counted with map-side
aggregation, and only one of them goes on. A class that still has too many distinct fragments for
one shard is halved: windows that start near the anchor share a core that goes further right,
windows that start far from it one that goes further left, so each half falls into classes of its
own, with shorter fragments that are counted again. After log2(reach) halvings a fragment is a
single window; long before that most classes fit the index.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.buffers import Polynomial, digests, inner_places, mix, pieces, texts
from marlstone.llm.shared import discard, met_by_count, written
from marlstone.llm.windows import row_keys

#: Distinct fragments that a class may bring to a shard; larger ones are halved.
CLASS_ROWS = 1024
#: Fragments that an operator's index holds at once, and their bytes.
SHARD_ROWS = 12_000
SHARD_BYTES = 8_000_000


class Symbols(NamedTuple):
    """The symbols of several texts end to end."""

    hashes: Polynomial
    #: Number of the first symbol of every text, and the number of all symbols.
    firsts: np.ndarray
    #: Bytes that spell the symbols, and where each symbol begins and ends in them.
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray


#: From a buffer of texts and their offsets to their symbols.
Reader = Callable[[np.ndarray, np.ndarray], Symbols]


def tie_windows(symbols: Symbols, length: int, reach: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of a sequence of symbols that holds several texts.

    Returns, by anchor: the text, the anchor's symbol, least and most distance from a window's start
    to the anchor, the core's hash and the digest of the fragment's bytes.
    """
    polynomial, firsts = symbols.hashes, symbols.firsts
    n = int(firsts[-1])
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(n - gram + 1)
    lasts = last_least(polynomial.of(at, at + gram), reach)
    spans = np.diff(firsts)
    fit = np.flatnonzero(spans >= length)
    counts = spans[fit] - length + 1
    text = np.repeat(fit, counts)
    starts = inner_places(counts) + firsts[text]
    lasts = lasts[starts].astype(np.int64)
    change = np.ones(len(starts), bool)
    change[1:] = (lasts[1:] != lasts[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(change)
    tail = np.append(head[1:], len(starts)) - 1
    anchor, owner = lasts[head], text[head]
    most, least_x = anchor - starts[head], anchor - starts[tail]
    core = polynomial.of(anchor, anchor + (length - reach + 1))
    whole = digests(symbols.data, symbols.begin[anchor - most], symbols.end[anchor - least_x + length - 1])
    return owner, anchor, least_x, most, core, whole


def last_least(hashes: np.ndarray, reach: int) -> np.ndarray:
    """For every window of ``reach`` hashes, the last place that holds its least hash, by doubling."""
    value, place = hashes, np.arange(len(hashes), dtype=np.int32)
    have = 1
    while have < reach:
        step = min(have, reach - have)
        later = value[step:] <= value[:-step]
        place = np.where(later, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        have += step
    return place


_ANCHORS = "k1 long, k2 long, at int, least int, most int, core long, whole long"


def anchors(docs: DataFrame, read: Reader, length: int, reach: int, gram: int) -> DataFrame:
    """All anchors of the texts of ``docs`` (k1, k2, text)."""

    def run(batches):
        for batch in batches:
            for part, buffer, offsets in pieces(batch):
                symbols = read(buffer, offsets)
                owner, at, least, most, core, whole = tie_windows(symbols, length, reach, gram)
                k1, k2 = (np.asarray(part.column(c)) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[owner]), pa.array(k2[owner]), pa.array((at - symbols.firsts[owner]).astype(np.int32)), pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))],
                    names=["k1", "k2", "at", "least", "most", "core", "whole"],
                )

    return docs.select("k1", "k2", "text").mapInArrow(run, _ANCHORS)


def keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """k1, k2 (two hashes of a row's key and text) and the text, empty for null."""
    k1, k2 = row_keys(F.col(key), F.col(text))
    return df.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


_FRAGMENT = ["core", "least", "most", "whole"]


def sift(docs: DataFrame, read: Reader, length: int, reach: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Split what may repeat: (settled, open).

    ``settled``: (k1, k2, at, least, most) of anchors whose whole fragment is found elsewhere.
    ``open``: (core, k1, k2, at, least, most, times, hot) one place of each distinct fragment of the
    cores with fragments that differ, and whether the core has too many for one shard.
    """
    every = written(anchors(docs, read, length, reach, gram), "anchors")
    twice = written(every.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice", small=True)
    held = written(met_by_count(every, twice, ["core"], "n").drop("n"), "held")
    discard(every)
    counted = written(held.groupBy(*_FRAGMENT).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "at")).alias("place")), "fragments")
    settled = met_by_count(held, counted.filter("times > 1").select(*_FRAGMENT, "times"), _FRAGMENT, "times").select("k1", "k2", "at", "least", "most")
    open_ = met_by_count(counted, _varied(counted), ["core"], "n").select("core", "place.*", "least", "most", "times", "hot")
    return settled, open_


def _varied(counted: DataFrame) -> DataFrame:
    """(core, n, hot): cores with more than one distinct fragment, and whether they have too many."""
    sizes = counted.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return written(sizes.select("core", "n", (F.col("n") > CLASS_ROWS).alias("hot")), "varied", small=True)


_PIECES = "core long, k1 long, k2 long, at int, least int, most int, times long, hot boolean, piece binary"


def _binary(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of ``data`` as a binary array."""
    cut = np.ascontiguousarray(data[inner_places(size) + np.repeat(begin, size)])
    where = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(where), pa.py_buffer(cut)]).cast(pa.binary())


def fragments(docs: DataFrame, open_: DataFrame, read: Reader, length: int) -> DataFrame:
    """Fetch the bytes of the open fragments: ``open_`` with ``piece`` (binary)."""
    wanted = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "at", "least", "most", "times", "hot")).alias("wanted"))
    # rows that are equal in key and text are one here: any of them has the symbols
    rows = docs.join(wanted, ["k1", "k2"])

    def run(batches):
        for batch in batches:
            for part, buffer, offsets in pieces(batch):
                symbols = read(buffer, offsets)
                lists = part.column("wanted")
                owner = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                flat = lists.flatten()
                core, at, least, most, times = (np.asarray(flat.field(i)) for i in range(5))
                first = symbols.firsts[owner] + at - most
                begin, end = symbols.begin[first], symbols.end[first + (most - least + length - 1)]
                k1, k2 = (np.asarray(part.column(c)) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core), pa.array(k1[owner]), pa.array(k2[owner]), pa.array(at), pa.array(least), pa.array(most), pa.array(times), flat.field(5), _binary(symbols.data, begin, end - begin)],
                    names=["core", "k1", "k2", "at", "least", "most", "times", "hot", "piece"],
                )

    return rows.mapInArrow(run, _PIECES)


def by_shards(fetched: DataFrame, index: Callable, length: int) -> DataFrame:
    """Run ``index`` over shards of whole classes: (k1, k2, begin, end) of repeated stretches.

    ``index(pieces, core, least, most, times)`` returns a matrix of flags: fragment by distance from
    the window's start to the anchor. A shard holds the classes that one task meets in a row: fewer
    than ``SHARD_ROWS`` and ``CLASS_ROWS`` fragments together, however many rows a batch has, and
    about ``SHARD_BYTES`` of them. Only a class of longer fragments brings more bytes.
    """

    def settle(table: pa.Table):
        core, k1, k2, at, least, most, times = (table.column(c).to_numpy() for c in ("core", "k1", "k2", "at", "least", "most", "times"))
        flags = index(table.column("piece").to_pylist(), core, least.astype(np.int64), most.astype(np.int64), times)
        edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(k1[row]), pa.array(k2[row]), pa.array((at[row] - (high - 1)).astype(np.int32)), pa.array((at[row] - low + length).astype(np.int32))],
            names=["k1", "k2", "begin", "end"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        count = size = 0
        for part, buffer, _ in (x for b in batches for i in range(0, b.num_rows, CLASS_ROWS) for x in pieces(b.slice(i, CLASS_ROWS), "piece")):
            held.append(part)
            count += part.num_rows
            size += len(buffer)
            if count >= SHARD_ROWS or size >= SHARD_BYTES:
                table = pa.Table.from_batches(held)
                core = table.column("core").to_numpy()
                cut = int(np.searchsorted(core, core[-1], side="left"))
                if cut:
                    yield settle(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    count = table.num_rows - cut
                    size = sum(len(texts(b.column("piece"))[0]) for b in held)
        if count:
            yield settle(pa.Table.from_batches(held))

    dealt = fetched.filter("NOT hot").repartition("core").sortWithinPartitions("core")
    return dealt.mapInArrow(run, "k1 long, k2 long, begin int, end int")


def halved(hot: DataFrame, read: Reader, length: int) -> DataFrame:
    """Both halves of every fragment of the hot classes (``low`` to ``high``: the class's distances).

    The windows at distances a to b share the symbols from a before the anchor to ``length - b``
    behind it: their new core.
    """

    def run(batches):
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            raw = batch.column("piece").to_pylist()
            symbols = read(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *(len(x) for x in raw)]))
            low, high, least, most, k1, k2, at, times = (np.asarray(batch.column(c)) for c in ("low", "high", "least", "most", "k1", "k2", "at", "times"))
            anchor = symbols.firsts[:-1] + most
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                near, far = np.maximum(least, a), np.minimum(most, b)
                row = np.flatnonzero(near <= far)
                a, b, near, far, here = a[row], b[row], near[row], far[row], anchor[row]
                core = digests(symbols.data, symbols.begin[here - a], symbols.end[here - b + length - 1])
                core = mix(core ^ mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)))
                begin, end = symbols.begin[here - far], symbols.end[here - near + length - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(digests(symbols.data, begin, end).view(np.int64)), pa.array(k1[row]), pa.array(k2[row]), pa.array(at[row])]
                    + [pa.array(x.astype(np.int32)) for x in (near, far, a, b)] + [pa.array(times[row]), _binary(symbols.data, begin, end - begin)],
                    names=["core", "whole", "k1", "k2", "at", "least", "most", "low", "high", "times", "piece"],
                )

    return hot.mapInArrow(run, "core long, whole long, k1 long, k2 long, at int, least int, most int, low int, high int, times long, piece binary")


def by_halves(fetched: DataFrame, read: Reader, index: Callable, length: int, reach: int) -> list[DataFrame]:
    """(k1, k2, begin, end) tables of the repeated stretches of the hot classes, one or two a round."""
    out = []
    hot = fetched.filter("hot").withColumn("low", F.lit(0)).withColumn("high", F.lit(reach - 1))
    while not hot.isEmpty():
        halves = written(halved(hot, read, length), "halves")
        counted = written(halves.groupBy(*_FRAGMENT).agg(F.count(F.lit(1)).alias("rows"), F.sum("times").alias("total"), F.min(F.struct("k1", "k2", "at")).alias("place")), "half-fragments")
        again = met_by_count(halves, counted.filter("total > 1").select(*_FRAGMENT, "rows"), _FRAGMENT, "rows")
        out.append(again.select("k1", "k2", (F.col("at") - F.col("most")).alias("begin"), (F.col("at") - F.col("least") + length).alias("end")))
        one = met_by_count(counted, _varied(counted), ["core"], "n").select(*_FRAGMENT, "place.*", F.col("total").alias("times"), "hot")
        level = written(halves.drop("times").join(one, [*_FRAGMENT, "k1", "k2", "at"]), "half-pieces")
        out.append(by_shards(level, index, length))
        hot = level.filter("hot")
    return out


def repeated_spans(docs: DataFrame, read: Reader, index: Callable, length: int, reach: int, gram: int) -> DataFrame:
    """(k1, k2, spans): by row, the maximal runs of symbols covered by repeated windows, in order."""
    settled, open_ = sift(docs, read, length, reach, gram)
    fetched = written(fragments(docs, open_, read, length), "pieces")
    every = settled.select("k1", "k2", (F.col("at") - F.col("most")).alias("begin"), (F.col("at") - F.col("least") + length).alias("end"))
    for part in [by_shards(fetched, index, length), *by_halves(fetched, read, index, length, reach)]:
        every = every.unionByName(part)
    every = written(every, "stretches")
    discard(fetched)
    # sets first: rows that repeat without end, in key and text, bring each stretch once from a task
    sets = every.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("s"))
    along = Window.partitionBy("k1", "k2").orderBy("begin", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        sets.select("k1", "k2", F.inline_outer("s"))
        .withColumn("_new", F.coalesce(F.col("begin") > reached, F.lit(True)).cast("int"))
        .withColumn("_run", F.sum("_new").over(along))
        .groupBy("k1", "k2", "_run")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    )
    return written(runs.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans")), "spans")


def gaps(spans: Column, size: Column) -> Column:
    """What lies between the spans: array of (begin, end), empty ones included."""
    none = F.array().cast("array<int>")
    ends = F.concat(F.array(F.lit(0)), F.coalesce(spans["end"], none))
    begins = F.concat(F.coalesce(spans["begin"], none), F.array(size))
    return F.zip_with(ends, begins, lambda a, b: F.struct(a.alias("begin"), b.alias("end")))
