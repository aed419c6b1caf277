"""Pairs of spans and phrases that may decide a span's ranking, found block against block.

The score of a pair is at most the blend of its vector score and of the shares of signs that its
texts have in common, whatever their order. Both bounds are matrix products. A span's pairs are
scored in the order of their bounds, and only until neither the best phrase of an entity nor the best
entities of the span can change: what is left out cannot show in the result.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from marlstone.functions.text import transliterate

#: Weights of vector, character and transliteration score; pairs under ``LEAST_VECTOR`` count only
#: if their phrase has at most ``SHORT`` signs.
WEIGHTS = {"embedding": 0.65, "character": 0.25, "transliteration": 0.10}
LEAST_VECTOR, SHORT = 0.35, 8

#: Phrases and spans that meet in one task at most, and tasks that are worth having.
PHRASES, SPANS, TASKS = 8192, 16_384, 32
#: Spans that are compared with a block of phrases at once, and pairs that are scored first.
ROWS, FIRST = 128, 64
#: Signs counted by number; those beyond are bounded by how many there are.
SIGNS = 512
#: Scores closer than this may be equal when they are rounded to six places.
NEAR = 2e-6


class _Texts:
    """Upper bounds of :func:`matched_share` between two lists of texts."""

    def __init__(self, left: list[str], right: list[str]) -> None:
        counted = [[Counter(t) for t in side] for side in (left, right)]
        number = [Counter((s, k) for c in side for s, n in c.items() for k in range(n)) for side in counted]
        common = sorted(number[0].keys() & number[1].keys(), key=lambda f: (-number[1][f], f))[:SIGNS]
        place = {f: i for i, f in enumerate(common)}
        self.marks = [self._marks(side, place) for side in counted]
        self.size = [np.array([len(t) for t in side], np.float64) for side in (left, right)]
        self.rest = [size - m.sum(1) for size, m in zip(self.size, self.marks, strict=True)]
        self.all_marked = len(common) == len(number[0].keys() & number[1].keys())

    @staticmethod
    def _marks(counted: list[Counter], place: dict) -> np.ndarray:
        out = np.zeros((len(counted), len(place)), np.float32)
        for row, c in enumerate(counted):
            for s, n in c.items():
                for k in range(n):
                    if (at := place.get((s, k))) is not None:
                        out[row, at] = 1
        return out

    def bound(self, rows: slice) -> np.ndarray:
        common = (self.marks[0][rows] @ self.marks[1].T).astype(np.float64)
        if not self.all_marked:
            common += np.minimum(self.rest[0][rows, None], self.rest[1][None])
        return 2 * common / np.maximum(self.size[0][rows, None] + self.size[1][None], 1)


def _share(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _vector_score(a: np.ndarray, b: np.ndarray) -> float:
    """The products summed from the left, as :func:`dot` does; what is no number counts as 1."""
    total = 0.0 + float(np.cumsum(a * b)[-1]) if len(a) else 0.0
    return 1.0 if np.isnan(total) else max(0.0, min(1.0, total))


def _vectors(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the rows and the matrix of their vectors (null elements: no number)."""
    lists = table.column("vector").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dimensions = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        dimensions[int(d)] = rows, flat[begin[rows, None] + np.arange(d)]
    return dimensions


def _error(a: np.ndarray, b: np.ndarray) -> float:
    """How far a matrix product may be from the sums from the left."""
    longest = [np.sqrt((m[np.isfinite(m).all(1)] ** 2).sum(1)).max(initial=0.0) for m in (a, b)]
    error = 4 * a.shape[1] * np.finfo(np.float64).eps * longest[0] * longest[1]
    return float(error) if np.isfinite(error) else np.inf


def _deciding(bound, entity, entities: int, top: int, near: float, score) -> list[tuple]:
    """(phrase, scores...) of one span: the pairs that may be the best of an entity among the ``top``
    best entities. ``bound`` is negative where a pair does not count; ``score(j)`` is (blend, ...) or
    None."""
    best = np.full(entities, -np.inf)
    lead: list[int] = []
    least = -np.inf
    scored: dict[int, tuple | None] = {}

    def walk(order: np.ndarray) -> None:
        nonlocal least
        for j in order.tolist():
            if bound[j] < 0 or bound[j] < least - near:
                return
            e = entity[j]
            if j in scored or bound[j] < best[e] - near:
                continue
            scored[j] = s = score(j)
            if s is None or s[0] <= best[e]:
                continue
            best[e] = s[0]
            if e not in lead:
                lead.append(e)
                if len(lead) > top:
                    lead.remove(min(lead, key=best.__getitem__))
            if len(lead) == top:
                least = min(best[x] for x in lead)

    if len(bound) > FIRST:
        first = np.argpartition(-bound, FIRST)[:FIRST]
        walk(first[np.argsort(-bound[first], kind="stable")])
    rest = np.flatnonzero((bound >= 0) & (bound >= least - near) & (bound >= best[entity] - near))
    walk(rest[np.argsort(-bound[rest], kind="stable")])
    return [(j, *s[1:]) for j, s in scored.items() if s is not None and s[0] >= best[entity[j]] - near and best[entity[j]] >= least - near]


def deciding_pairs(spans: pa.Table, phrases: pa.Table, top: int) -> tuple[np.ndarray, ...]:
    """Span, phrase, vector, character and transliteration score of the pairs that may decide."""
    left, right = spans.column("phrase").to_pylist(), phrases.column("normalized_phrase").to_pylist()
    left_latin, right_latin = spans.column("_latin").to_pylist(), phrases.column("_latin").to_pylist()
    codes = phrases.column("entity_id").combine_chunks().dictionary_encode(null_encoding="encode")
    entities, codes = len(codes.dictionary), codes.indices.to_numpy(zero_copy_only=False)
    brief = np.array([p is not None and len(p) <= SHORT for p in right], bool)
    w = list(WEIGHTS.values())
    out: list[tuple] = []
    others = _vectors(phrases)
    for d, (mine, a) in _vectors(spans).items():
        if d not in others:
            continue
        theirs, b = others[d]
        pick = lambda side, rows: [side[i] or "" for i in rows]
        texts = _Texts(pick(left, mine), pick(right, theirs))
        plain = pick(left, mine) == pick(left_latin, mine) and pick(right, theirs) == pick(right_latin, theirs)
        latin = texts if plain else _Texts(pick(left_latin, mine), pick(right_latin, theirs))
        error = _error(a, b)
        near = NEAR + 2 * error
        entity, short = codes[theirs], brief[theirs]
        for begin in range(0, len(mine), ROWS):
            rows = slice(begin, begin + ROWS)
            with np.errstate(all="ignore"):
                e = np.clip(a[rows] @ b.T, 0.0, 1.0)
            e[np.isnan(e)] = 1.0
            if not np.isfinite(error):
                e[:] = 1.0
            signs = texts.bound(rows)
            bound = w[0] * e + w[1] * signs + w[2] * (signs if plain else latin.bound(rows))
            bound[~((e >= LEAST_VECTOR - error) | short)] = -1
            for at in range(len(bound)):
                i = int(mine[begin + at])

                def score(j, i=i, x=a[begin + at]):
                    k = int(theirs[j])
                    with np.errstate(all="ignore"):
                        e = _vector_score(x, b[j])
                    if e < LEAST_VECTOR and not short[j]:
                        return None
                    c = _share(left[i], right[k])
                    t = c if left[i] == left_latin[i] and right[k] == right_latin[k] else _share(left_latin[i], right_latin[k])
                    return w[0] * e + w[1] * c + w[2] * t, e, c, t

                out += [(i, int(theirs[j]), *s) for j, *s in _deciding(bound[at], entity, entities, top, near, score)]
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    return tuple(np.array(c, t) for c, t in zip(columns, (np.int64, np.int64, float, float, float), strict=True))


def _blocks(spans: DataFrame, index: DataFrame) -> dict[str, tuple[int, int]]:
    """By entity type: into how many blocks its spans and its phrases are dealt."""
    sizes = [{r["entity_type"]: r["count"] for r in df.groupBy("entity_type").count().collect()} for df in (spans, index)]
    out = {}
    for kind in sizes[0].keys() & sizes[1].keys() - {None}:
        n, m = sizes[0][kind], sizes[1][kind]
        phrases = -(-m // PHRASES)
        out[kind] = max(-(-n // SPANS), min(-(-TASKS // phrases), -(-n // ROWS))), phrases
    return out


def best_pairs(spans: DataFrame, index: DataFrame, top: int) -> DataFrame:
    """Of all pairs of a span (span_id, entity_type, phrase, vector) and a phrase of its type, those
    that may be the best of their entity among the span's ``top`` best entities: span_id, phrase,
    entity_id, display, normalized_phrase, trusted and the scores e, c and t.

    A type's spans and phrases are dealt into blocks by hash, and every block meets every other in a
    task of its own: no type is too large for one task, and no block is larger for more rows. Types
    are few and counted first.
    """
    blocks = _blocks(spans, index)
    kinds = sorted(blocks)

    def number(side: int) -> Column:
        return F.coalesce(*[F.when(F.col("entity_type") == k, F.lit(blocks[k][side])) for k in kinds], F.lit(1))

    def dealt(df: DataFrame, own: str, other: str, side: int, *by: str) -> DataFrame:
        rows = df.filter(F.col("entity_type").isin(kinds) & F.col("vector").isNotNull())
        rows = rows.withColumn(own, F.pmod(F.xxhash64(*by), number(side)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), number(1 - side) - 1)))
        return rows.repartition(3 * sum(n * m for n, m in blocks.values()) or 1, *cell)

    cell = ["entity_type", "_span_block", "_phrase_block"]
    s = dealt(spans.select("span_id", "entity_type", "phrase", "vector", transliterate(F.col("phrase")).alias("_latin")), *cell[1:], 0, "span_id")
    x = index.select("entity_type", "entity_id", "display", "normalized_phrase", "trusted", "vector", transliterate(F.col("normalized_phrase")).alias("_latin"))
    x = dealt(x, *cell[:0:-1], 1, "entity_id", "normalized_phrase", "vector")
    of_span, of_phrase = ("span_id", "phrase"), ("entity_id", "display", "normalized_phrase", "trusted")
    schema = StructType([*[s.schema[c] for c in of_span], *[x.schema[c] for c in of_phrase], *[StructField(c, DoubleType()) for c in "ect"]])
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return arrow.empty_table()
        i, j, *scores = deciding_pairs(left, right, top)
        columns = [left.column(c).take(pa.array(i)) for c in of_span] + [right.column(c).take(pa.array(j)) for c in of_phrase]
        return pa.table([*columns, *[pa.array(v) for v in scores]], names=schema.names)

    return s.groupBy(*cell).cogroup(x.groupBy(*cell)).applyInArrow(run, schema)
