"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes the set of its distinct five-word shingles (64-bit hashes), a MinHash
   signature and band keys. Texts with equal sets are one node from here on, counted by map-side
   aggregation; a node has two independent 64-bit names, and nodes that share only the first are
   told apart by the second.
2. Nodes that share a band are candidates. Buckets with equal members in several bands are looked
   at once. A task compares the signatures of a bucket's nodes batch by batch: a pair is pruned as
   soon as, given the matches so far, the posterior probability that its similarity reaches the
   threshold falls under the miss probability. What survives is passed on as a spanning forest of
   the bucket, never as pairs.
3. Forests join into clusters. Each cluster's full sets meet in one task, which again walks pairs
   batch by batch and confirms survivors on the full sets. Pairs that are connected already need no
   check. Only confirmed links make components.

Buckets and clusters that are too large for one task are dealt into blocks by a hash of the node,
and every block is walked alone. One node of each part that hangs together then stands for it: these
are dealt and walked again, until they fit one block. Where a group is in several parts even then,
the nodes outside its largest part meet all the others, block by block: nothing is capped, and a
group of near copies is sent about once instead of once for each of its blocks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.buffers import Polynomial, mix, pieces, word_codes, words
from marlstone.llm.components import components
from marlstone.llm.shared import discard, few_files, row_hash, sieved, table, written
from marlstone.llm.windows import row_keys

WORDS = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-7
#: The pipeline stage links texts from this similarity on; op10 has its own, 85.
STAGE_PERCENT = 80
#: Nodes, and shingles, of a block, on average; a task holds two blocks at most.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 2_000_000

_rng = np.random.default_rng(85)
_FLIP = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within the text, and where each text's begin.

    A text of fewer words than a shingle has its whole sequence as one; without words, none.
    """
    low = _LOWER[buffer]
    starts, ends, firsts = words(low, offsets)
    codes = word_codes(low, starts, ends) | np.uint64(1)
    count = np.diff(firsts)
    number = np.where(count == 0, 0, np.maximum(count - WORDS + 1, 1))
    owner = np.repeat(np.arange(len(count)), number)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + firsts[owner]
    end = np.minimum(begin + WORDS, firsts[owner + 1]) if len(owner) else begin
    hashes = Polynomial(codes).of(begin, end)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(count) + 1))


def _by_text(ufunc, values: np.ndarray, firsts: np.ndarray, full: np.ndarray) -> np.ndarray:
    return ufunc.reduceat(values, firsts[:-1][full])


def node_names(hashes: np.ndarray, firsts: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of every set that is not empty, from sums over its members."""
    a = _by_text(np.add, mix(hashes ^ np.uint64(0xA5A5)), firsts, full)
    b = _by_text(np.add, mix(hashes + np.uint64(0x1234567)), firsts, full)
    size = np.diff(firsts)[full].astype(np.uint64)
    return mix(a ^ (size * np.uint64(3))).view(np.int64), mix(b + size).view(np.int64)


def signatures(docs: DataFrame, key_type: str) -> DataFrame:
    """(id, node, other, n, signature, bands) of rows (id, text); both names are null for empty sets."""

    def run(batches):
        for batch in batches:
            for part, buffer, offsets in pieces(batch):
                hashes, firsts = shingle_sets(buffer, offsets)
                n = np.diff(firsts)
                full = np.flatnonzero(n)
                marks = np.zeros((len(n), HASHES), np.uint8)
                keys = np.zeros((len(n), BANDS), np.uint64)
                names = np.zeros((2, len(n)), np.int64)
                if len(full):
                    names[:, full] = node_names(hashes, firsts, full)
                    for k in range(HASHES):
                        least = mix(_by_text(np.minimum, (hashes ^ _FLIP[k]) * _TIMES[k], firsts, full))
                        marks[full, k] = (least & np.uint64(255)).astype(np.uint8)
                        band = k // ROWS
                        keys[full, band] = mix(keys[full, band] * np.uint64(0x100000001B3) ^ least ^ np.uint64(band + 1))
                sig = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * HASHES).astype(np.int32)), pa.py_buffer(marks)])
                bands = pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * BANDS).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                node, other = (pa.array(x, mask=n == 0) for x in names)
                yield pa.RecordBatch.from_arrays([part.column("id"), node, other, pa.array(n.astype(np.int64)), sig, bands], names=["id", "node", "other", "n", "signature", "bands"])

    return docs.mapInArrow(run, f"id {key_type}, node long, other long, n long, signature binary, bands array<long>")


def told_apart(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every, firsts): rows whose first names are equal but whose second names differ get new first
    names; ``firsts`` has the least id of each node."""
    for _ in range(2):
        found = every.filter("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.min("other").alias("_least"), F.max("other").alias("_most"))
        firsts = written(found, "firsts", small=True)
        clash = firsts.filter("_least <> _most").select("node", "_least")
        if clash.isEmpty():
            break
        renamed = F.when(F.col("other") != F.col("_least"), F.xxhash64("node", "other")).otherwise(F.col("node"))
        every = written(every.join(clash, "node", "left").withColumn("node", renamed).drop("_least"), "signatures")
    return every, firsts.select("node", "first")


@functools.cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For every batch end: the fewest matches at which a pair lives on.

    Uniform prior over similarity s; signature bytes match with probability s + (1 - s) / 256. The
    posterior of s >= threshold after m matches of n is integrated numerically.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p + 1e-300)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() >= miss * weight.sum():
                out.append(m)
                break
    return tuple(out)


def survivors(signature: np.ndarray, one: int, others: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Those of ``others`` that no batch of signature bytes prunes as partners of ``one``."""
    matches = np.zeros(len(others), np.int64)
    for i, needed in enumerate(least):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        matches += (signature[others, cut] == signature[one, cut]).sum(axis=1)
        keep = matches >= needed
        if not keep.all():
            others, matches = others[keep], matches[keep]
        if not len(others):
            break
    return others


class Forest:
    """Union-find whose labels can be compared all at once; it begins with the given parts."""

    def __init__(self, parts: np.ndarray) -> None:
        names, self.label = np.unique(parts, return_inverse=True)
        order = np.argsort(self.label, kind="stable")
        cuts = np.cumsum(np.bincount(self.label, minlength=len(names)))[:-1]
        self.members = [x.tolist() for x in np.split(order, cuts)]

    def join(self, a: int, b: int) -> bool:
        a, b = self.label[a], self.label[b]
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        return True


def _groups(batches, *columns: str):
    """Whole groups of rows with equal ``columns`` from batches sorted by them."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = np.stack([now.column(c).to_numpy() for c in columns])
        heads = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if now.num_rows else np.zeros(0, int)
        if not len(heads):
            continue
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            yield now.slice(a, b - a)
        held = now.slice(heads[-1])
    if held is not None and held.num_rows:
        yield held


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _edges(a: list, b: list):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _walk(rows: DataFrame, columns: tuple[str, ...], checker) -> DataFrame:
    """(a, b): for every group (key, low, high) of rows a spanning forest of the pairs that pass.

    ``part``: what hangs together already needs no check. Where ``low`` and ``high`` differ only
    pairs from different blocks (``mine``) are looked at. ``checker(group, signatures)`` gives a
    function from a row and its possible partners to those that pass.
    """

    def run(batches):
        a: list[int] = []
        b: list[int] = []
        for group in _groups(batches, "key", "low", "high"):
            node, part, mine = (group.column(c).to_numpy() for c in ("node", "part", "mine"))
            forest = Forest(part)
            if len(forest.members) < 2:
                continue
            apart = bool((mine != mine[0]).any())
            passing = checker(group, _matrix(group.column("signature")))
            for i in range(len(node) - 1):
                others = np.arange(i + 1, len(node))
                fresh = forest.label[others] != forest.label[i]
                others = others[fresh & (mine[others] != mine[i]) if apart else fresh]
                if not len(others):
                    continue
                for j in passing(i, others):
                    if forest.join(i, int(j)):
                        a.append(node[i])
                        b.append(node[j])
            if len(a) > 10_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    dealt = rows.select("key", "low", "high", "node", "part", "mine", *columns).repartition("key", "low", "high")
    return dealt.sortWithinPartitions("key", "low", "high").mapInArrow(run, "a long, b long")


def candidates(rows: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs whose signatures no batch prunes."""

    def checker(group, signature):
        least = least_matches(threshold, miss)
        return lambda i, others: survivors(signature, i, others, least)

    return _walk(rows, ("signature",), checker)


def confirmed(rows: DataFrame, threshold_percent: int, miss: float) -> DataFrame:
    """Pairs that no batch prunes and whose full sets are similar enough."""

    def checker(group, signature):
        least = least_matches(threshold_percent / 100, miss)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("members").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        names, ids = np.unique(flat, return_inverse=True)
        by_name = np.argsort(ids, kind="stable")
        posting, at = owner[by_name], np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(names)))])
        begin = np.cumsum(sizes) - sizes

        def passing(i: int, others: np.ndarray) -> np.ndarray:
            others = survivors(signature, i, others, least)
            if not len(others):
                return others
            if len(others) <= 8:
                shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others])
            else:  # all at once, by the postings of this set's members
                mine = ids[begin[i] : begin[i] + sizes[i]]
                length = at[mine + 1] - at[mine]
                index = np.arange(length.sum()) + np.repeat(at[mine] - (np.cumsum(length) - length), length)
                shared = np.bincount(posting[index], minlength=len(sets))[others]
            return others[100 * shared >= threshold_percent * (sizes[i] + sizes[others] - shared)]

        return passing

    return _walk(rows, ("signature", "members"), checker)


def _blocks(size: str = "size", weight: str = "weight"):
    return F.greatest(F.ceil(F.col(size) / BLOCK_NODES), F.ceil(F.col(weight) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _place(blocks, salt: str):
    return F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")


def _alone(rows: DataFrame, walk, salt: str, label: str) -> DataFrame:
    """Links inside the blocks that the groups of ``rows`` (key, node, n, size, weight) are dealt into."""
    dealt = rows.withColumn("mine", _place(_blocks(), salt)).withColumn("part", F.col("node"))
    return written(walk(dealt.withColumn("low", F.col("mine")).withColumn("high", F.col("mine"))), label, small=True)


def linked(rows: DataFrame, walk, label: str) -> DataFrame:
    """(a, b): links that connect all pairs of one group which ``walk`` lets pass.

    ``rows``: key, node, n (shingles), size and weight (nodes and shingles of the group) and what
    ``walk`` needs.
    """
    links = _alone(rows, walk, "0", label)
    many = rows.filter(_blocks() > 1)
    if many.isEmpty():
        return links
    many = written(many, f"{label}-large")
    before, now = None, many
    while True:  # one node for each part, until these fit a block or do not get fewer
        parts = components(links, f"{label}-parts")
        marked = many.join(parts.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        heads = marked.groupBy("key", "part").agg(F.min("node").alias("node"), F.min_by("n", "node").alias("n"))
        sizes = heads.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
        sizes = written(sizes, f"{label}-heads", small=True)
        total, most = sizes.agg(F.sum("size"), F.max(_blocks())).first()
        if before is not None and (done or total * 2 > before):
            break
        now = many.drop("size", "weight").join(heads.select("key", "node"), ["key", "node"]).join(sizes, "key")
        links = links.union(_alone(now, walk, f"1-{total}", label))
        before, done = total, most == 1
    return links.union(_across(marked, walk, label))


def _across(marked: DataFrame, walk, label: str) -> DataFrame:
    """Links between the parts that the groups of ``marked`` are still in. The largest part is dealt
    into blocks of its own; the nodes outside it, strays, meet every block."""
    parts = marked.groupBy("key", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    largest = F.max_by(F.struct("part", "k", "w"), F.struct("k", "part"))
    open_ = parts.groupBy("key").agg(largest.alias("m"), F.sum("k").alias("k"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    plan = open_.select(
        "key", F.col("m.part").alias("main"), F.col("m.k").alias("size"), F.col("m.w").alias("weight"), (F.col("k") - F.col("m.k")).alias("s"), (F.col("w") - F.col("m.w")).alias("t")
    ).select("key", "main", _blocks().alias("mains"), _blocks("s", "t").alias("strays"))
    plan = written(plan, f"{label}-plan", small=True)
    joined = marked.join(plan, "key")
    main = F.col("part") == F.col("main")
    mine = F.when(main, _place(F.col("mains"), "2")).otherwise(F.col("mains") + _place(F.col("strays"), "2"))
    other = F.explode(F.sequence(F.when(main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("strays") - 1))
    pairs = joined.withColumn("mine", mine).withColumn("other", other)
    return written(walk(pairs.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))), label, small=True)


def near_duplicates(df: DataFrame, percent: int = 85, miss: float = MISS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept): near-duplicate components of ``df``.

    Two rows are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Words
    are runs of anything but ASCII white space, A-Z lower-cased. Texts without words and null texts
    have empty sets, are linked with nothing and are their own component. ``component_id`` is the
    least key that links reach (keys of null are passed over); ``kept`` marks the row with that key,
    and rows of null key. Equal rows get equal results. One row for each row of ``df``.
    """
    key_type = dict(df.dtypes)[key]
    source = df.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    every, firsts = told_apart(written(signatures(source, key_type), "signatures"))
    nodes = written(every.filter("n > 0").select("node", "other", "n", "signature", "bands").dropDuplicates(["node"]), "nodes")

    # a bucket holds signatures only: their sets weigh nothing there
    banded = nodes.select("node", F.lit(0).cast("long").alias("n"), F.explode("bands").alias("key"))
    buckets = (
        banded.groupBy("key")
        .agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        .filter("size > 1")
    )
    # Buckets with the same members are looked at once.
    buckets = written(buckets.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size"), "buckets", small=True)
    members = written(banded.join(buckets, "key"), "bucket-members")
    signed = members.join(nodes.select("node", "signature"), "node").withColumn("weight", F.lit(0).cast("long"))
    forest = linked(signed, lambda rows: candidates(rows, percent / 100, miss), "survivors")

    clusters = written(components(forest, "survivor-links"), "clusters", small=True)
    discard(members)
    sizes = written(clusters.join(nodes.select("node", "n"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")), "cluster-sizes", small=True)
    placed = clusters.join(sizes, "root").join(firsts, "node").join(nodes.select("node", "other", "n"), "node")
    placed = written(placed.select(F.col("root").alias("key"), "node", "other", "n", "size", "weight", F.col("first").alias("id")), "placed", small=True)
    # A first id of null is looked up as null. The plan is the same at every size: sorted and merged.
    carried = ("key", "node", "n", "size", "weight")
    # Texts outside the clusters stay where they are.
    wanted = sieved(source, ["id"], placed).filter("__maybe").drop("__maybe")
    fetched = wanted.join(placed.hint("merge").withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id"))).drop("_id", "id")

    def with_sets(batches):
        for batch in batches:
            for part, buffer, offsets in pieces(batch):
                hashes, firsts_ = shingle_sets(buffer, offsets)
                full = np.flatnonzero(np.diff(firsts_))
                if not len(full):
                    continue
                _, other = node_names(hashes, firsts_, full)
                here = pa.Table.from_batches([part]).take(pa.array(full))
                right = other == here.column("other").to_numpy()  # rows may share an id
                sets = [hashes[firsts_[i] : firsts_[i + 1]].tobytes() for i in full[right]]
                here = here.filter(pa.array(right))
                batch_out = pa.Table.from_arrays([here.column(c) for c in carried] + [pa.array(sets, pa.binary())], names=[*carried, "members"])
                yield from batch_out.combine_chunks().to_batches()

    sets = fetched.mapInArrow(with_sets, "key long, node long, n long, size long, weight long, members binary")
    full = written(sets.join(nodes.select("node", "signature"), "node").dropDuplicates(["node"]), "sets")
    links = linked(full, lambda rows: confirmed(rows, percent, miss), "links")
    rooted = written(components(links, "link-rounds"), "components", small=True)
    discard(full)
    lowest = rooted.join(firsts, "node").groupBy("root").agg(F.min("first").alias("least"))
    lowest = written(lowest, "lowest", small=True)
    found = rooted.join(lowest, "root").select("node", "least")
    known = written(firsts.join(found, "node", "left").select("node", F.coalesce("least", "first").alias("component_id")), "known", small=True)
    out = every.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "node").join(known, "node", "left").drop("node")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op10_bayesian_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 85 percent of five-word shingles."""
    return few_files(near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group stays. Texts are linked at ``STAGE_PERCENT`` of their
    five-word shingles.

    Rows are told apart by doc_id and text, so rows that share an id, or have none, are judged by
    their own texts. The row with the least doc_id stays, null ids last; of rows of one id the one
    with the least hash; of rows that are equal in doc_id and text the one with the least hash of
    all columns. Rows without words are in no group and all stay.
    """
    keys = ["__k1", "__k2"]
    keyed = docs.withColumns(dict(zip(keys, row_keys(F.col("doc_id"), F.col("text")), strict=True)))
    # a struct compares field by field
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"))
    found = near_duplicates(keyed.select(name.alias("row"), "text"), STAGE_PERCENT, key="row").filter("n_shingles > 0")
    marked = found.groupBy("row.k1", "row.k2").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marked = written(marked.filter("NOT kept OR n > 1").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "kept"), "near-copies", small=True)
    # rows that no decision touches are not shuffled
    sorted_out = sieved(keyed, keys, marked)
    doubtful = sorted_out.filter("__maybe").drop("__maybe")
    out = sorted_out.filter("NOT __maybe").select(*[f"`{c}`" for c in docs.columns]).union(doubtful.join(marked.select(*keys), keys, "left_anti").select(*[f"`{c}`" for c in docs.columns]))
    equal = marked.filter("kept").select(*keys)
    if equal.isEmpty():
        return out
    # aggregated before it is shuffled, so that no task gets all rows of a group
    rows = doubtful.join(equal, keys).select(*keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), row_hash(docs).alias("__h"))
    return out.union(rows.groupBy(*keys).agg(F.min_by("__row", "__h").alias("__row")).select("__row.*"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0
), sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM starts
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
FROM least LEFT JOIN n USING (doc_id)
"""
