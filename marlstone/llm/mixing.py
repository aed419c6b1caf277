"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same set of sources form a membership pattern. A pattern can send its
tokens to any source it belongs to, first once, then again and again, each repetition dearer than
the one before (convex cost). The cheapest flow of tokens from patterns to source quotas says how
many tokens of a pattern are taken; whole repetitions go to all its documents, the rest to seeded
documents in hash order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import count_space_words, few_files, table, text_or_empty, written
from marlstone.llm.windows import one_of_each, repeated, row_names


def water_fill(sizes: Mapping[str | None, int], weights: Mapping[str | None, float], total: float, most: float) -> dict:
    """Share ``total`` by weight, no source above ``most`` times its size; excess is shared again."""
    target = {s: 0.0 for s in sizes}
    free, left = {s for s in sizes if sizes[s] > 0 and weights[s] > 0}, float(total)
    while free:
        share = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * share > most * sizes[s]}
        if not full:
            for s in free:
                target[s] = float(weights[s] * share)
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= full
    return target


def cheapest_routes(
    capacity: Mapping[tuple, int], quota: Mapping, repeats: int
) -> dict[tuple[tuple, object], int]:
    """Min-cost flow by successive shortest paths.

    ``capacity``: tokens of each membership pattern (a tuple of sources); ``quota``: tokens that
    each source wants. Repetition r of a pattern costs r per token, which is convex in its flow.
    Among equally cheap paths the order of patterns and sources decides, so reruns agree. Returns
    the tokens that go from a pattern to a source.
    """
    patterns, sources = list(capacity), list(quota)
    n = 2 + len(patterns) + len(sources)
    start, end = 0, n - 1
    heads: list[int] = []
    room: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]

    def edge(a: int, b: int, cap: int, cost: int) -> None:
        for x, y, c, p in ((a, b, cap, cost), (b, a, 0, -cost)):
            out[x].append(len(heads))
            heads.append(y)
            room.append(c)
            price.append(p)

    at = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    routes = {}
    for i, p in enumerate(patterns):
        for r in range(repeats):
            edge(start, 1 + i, capacity[p], r)
        for s in p:
            if s in at:
                routes[p, s] = len(heads)
                edge(1 + i, at[s], capacity[p] * repeats, 0)
    for s in sources:
        edge(at[s], end, quota[s], 0)
    while True:
        cost, via, queued = [None] * n, [-1] * n, [False] * n
        cost[start], queue = 0, deque([start])
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in out[x]:
                y = heads[e]
                if room[e] > 0 and (cost[y] is None or cost[x] + price[e] < cost[y]):
                    cost[y], via[y] = cost[x] + price[e], e
                    if not queued[y]:
                        queued[y] = True
                        queue.append(y)
        if cost[end] is None:
            return {k: room[e ^ 1] for k, e in routes.items() if room[e ^ 1]}
        x, push = end, None
        while x != start:
            push = room[via[x]] if push is None else min(push, room[via[x]])
            x = heads[via[x] ^ 1]
        x = end
        while x != start:
            room[via[x]] -= push
            room[via[x] ^ 1] += push
            x = heads[via[x] ^ 1]


def plan_flow(capacity: Mapping[tuple, int], quota: Mapping, repeats: int, max_overlaps: int = 20_000) -> dict[tuple[tuple, object], int]:
    """Cheapest tokens from patterns to sources. A source whose documents all belong to it alone
    gets what its own pattern can give; the others, which share documents, go through the flow."""
    shared = {s for p in capacity if len(p) > 1 for s in p}
    flow = {(p, p[0]): min(quota[p[0]], v * repeats) for p, v in capacity.items() if len(p) == 1 and p[0] not in shared}
    rest = {p: v for p, v in capacity.items() if shared.intersection(p)}
    if len(rest) > max_overlaps:
        raise ValueError(f"more than {max_overlaps} patterns of overlapping sources")
    return {k: v for k, v in flow.items() if v} | cheapest_routes(rest, {s: quota[s] for s in quota if s in shared}, repeats)


def mix_sources(
    df: DataFrame,
    size: Column,
    members: Column,
    weights_of,
    key: str = "doc_id",
    total: float | None = None,
    most: int = 3,
    seed: str = "mix",
    max_patterns: int = 1_000_000,
    rows_per_bin: int = 20_000,
) -> DataFrame:
    """Add ``size``, ``taken`` (tokens taken, repeats counted), and of the row's sources ``pattern``
    (their names), ``source_sizes`` and ``source_targets``. Columns of these names are replaced.

    ``members``: array of the sources that a row belongs to, none null (a null source is given a
    name by the caller). ``weights_of``: function from the list of sources in code point order to
    their weights. Only sums by pattern reach the driver; more than ``max_patterns`` patterns raise
    an error. A pattern's rest goes to documents in the order of a seeded hash of the row: sums by
    hash bin find the bin in which the rest ends, and rows are summed up only inside that bin, so
    no task gets a whole source. Equal rows are counted and decided together, however many there
    are; some of them may be taken once more than the others. Rows without tokens take none; an
    empty table gives an empty result.
    """
    rows = df.drop("taken", "source_sizes", "source_targets").withColumn("size", size.cast("long")).withColumn("pattern", F.array_sort(F.array_distinct(members)))
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n"))
    got = sums.limit(max_patterns + 1).collect()
    if len(got) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {tuple(r["pattern"]): r["tokens"] for r in sorted(got, key=lambda r: list(r["pattern"]))}
    sizes: dict = {}
    for p, tokens in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + tokens
    names = sorted(sizes)
    sizes = {s: sizes[s] for s in names}
    target = water_fill(sizes, dict(zip(names, weights_of(names), strict=True)), sum(capacity.values()) if total is None else total, most)
    flow = plan_flow(capacity, {s: round(target[s]) for s in names}, most)
    spark, plan = df.sparkSession, []
    bins = max(64, -(-sum(r["n"] for r in got) // rows_per_bin))
    for p, tokens in capacity.items():
        goal = sum(flow.get((p, s), 0) for s in p)
        full = min(most, goal // tokens) if tokens else 0
        plan.append((list(p), int(full), int(goal - full * tokens) if full < most else 0, [float(sizes[s]) for s in p], [float(target[s]) for s in p]))
    plan_df = spark.createDataFrame(plan, "pattern array<string>, __full long, __rest long, source_sizes array<double>, source_targets array<double>")

    r1, r2 = row_names(rows)
    named = rows.withColumn("__r1", r1).withColumn("__r2", r2)
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"), "__r1")
    counted = named.withColumn("__h", h).groupBy("pattern", "size", "__h", "__r1", "__r2").agg(F.count(F.lit(1)).alias("__n"))
    binned = written(counted.withColumn("__bin", F.pmod(F.shiftrightunsigned("__h", 20), F.lit(bins)).cast("int")), "row-sizes")
    per_bin = binned.groupBy("pattern", "__bin").agg(F.sum(F.col("size") * F.col("__n")).alias("__sum"))
    upto = Window.partitionBy("pattern").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        per_bin.withColumn("__before", F.coalesce(F.sum("__sum").over(upto), F.lit(0)))
        .join(plan_df, "pattern")
        .withColumn("__left", F.col("__rest") - F.col("__before"))
        .withColumn("__whole", F.col("__left") >= F.col("__sum"))
        .drop("__sum", "__before", "__rest")
    )
    joined = binned.join(cuts, ["pattern", "__bin"])
    inside = Window.partitionBy("pattern", "__bin").orderBy("__h", "__r1", "__r2", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = joined.filter(~F.col("__whole") & (F.col("__left") > 0))
    prior = F.coalesce(F.sum(F.col("size") * F.col("__n")).over(inside), F.lit(0))
    # the document in which the rest ends is taken if most of it is wanted
    wanted = F.floor((F.col("__left") - prior) / F.nullif("size", F.lit(0)) + 0.5)
    picked = middle.withColumn("__more", F.coalesce(F.greatest(F.lit(0), F.least("__n", wanted)), F.lit(0)).cast("long"))
    rest = joined.filter(F.col("__whole") | (F.col("__left") <= 0)).withColumn("__more", F.when(F.col("__whole"), F.col("__n")).otherwise(0).cast("long"))
    decided = written(picked.unionByName(rest).select("__r1", "__r2", "__n", "__full", "__more", "source_sizes", "source_targets"), "decisions")
    extra = lambda copy: F.least(F.col("size") * most, F.col("size") * (F.col("__full") + (copy < F.col("__more")).cast("long"))).alias("taken")
    columns = [*rows.columns, "source_sizes", "source_targets"]
    out = named.join(decided.filter("__n = 1"), ["__r1", "__r2"]).select(*columns, extra(F.lit(0)))
    if decided.filter("__n > 1").isEmpty():
        return out
    again = repeated(one_of_each(named, decided.filter("__n > 1"), rows.columns), "__n", "__copy")
    return out.unionByName(again.select(*columns, extra(F.col("__copy"))))


#: A null source is a source of its own; this name sorts after every other.
NO_SOURCE = "\U0010ffff\U0010ffff"


def cycled(weights: Sequence[float]):
    return lambda names: [float(weights[i % len(weights)]) for i in range(len(names))]


def count_words() -> Column:
    return count_space_words(text_or_empty())


def mix_documents(docs: DataFrame, size: Column) -> DataFrame:
    """``mix_sources`` with one source a document, weights 5, 2, 1 and all sizes shared. A document
    counts for its own source only, so no patterns overlap here and each route has one price list."""
    members = F.array(F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)))
    return mix_sources(docs, size, members, cycled((5, 2, 1)))


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", count_words().alias("size"))
    mixed = mix_documents(written(sized, "sized", small=True), F.col("size"))
    digest = mixed.select(
        "doc_id",
        "size",
        F.col("source_sizes")[0].cast("long").alias("source_size"),
        F.col("source_targets")[0].alias("target"),
        "taken",
    )
    return few_files(digest)


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a document is written as often as the mix takes it, at most three times.

    The mix is worked out on sizes alone; texts are read once to count their words and once to be
    written. Rows that are equal altogether are written as often as all of them are taken.
    """
    r1, r2 = row_names(docs)
    sized = written(docs.select(r1.alias("__k1"), r2.alias("__k2"), "doc_id", "source", count_words().alias("size")), "sized", small=True)
    mixed = mix_documents(sized, F.col("size")).filter("taken > 0")
    once = F.col("taken") / F.col("size")
    times = mixed.groupBy(F.col("__k1").alias("__r1"), F.col("__k2").alias("__r2")).agg(F.sum(once.cast("long")).alias("__times"))
    times = written(times, "times", small=True)
    named = docs.withColumn("__r1", r1).withColumn("__r2", r2)
    same = written(sized.groupBy(F.col("__k1").alias("__r1"), F.col("__k2").alias("__r2")).agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1"), "same", small=True)
    several = not same.isEmpty()
    single = times.join(same.select("__r1", "__r2"), ["__r1", "__r2"], "left_anti") if several else times
    joined = named.join(single.hint("merge"), ["__r1", "__r2"])
    out = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)
    if not several:
        return out
    equal = times.join(same.select("__r1", "__r2"), ["__r1", "__r2"])
    return out.unionByName(repeated(one_of_each(named, equal, docs.columns), "__times", "__copy").select(*docs.columns))
