"""Language identification by a convolutional network over bytes, trained here in numpy.

A text's bytes are cut into windows of fixed length, all of them. A window's bytes get short
vectors, filters of several widths slide over them, each filter keeps its greatest answer (max
pooling), and a linear layer with softmax gives the languages' probabilities. A text's probability
is the mean of its windows' by the bytes they hold. Windows go through the network in batches of
bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.buffers import pieces
from marlstone.llm.shared import few_files, filtered_apart, table, written

WINDOW = 192
DIM = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
_WIDE = max(WIDTHS)
_BATCH = 192
UNKNOWN = "und"

#: Bound of what is learned from: labelled texts in all.
TRAIN_TEXTS = 4000
#: The pipeline stage rejects texts whose best language is no likelier than this many times chance.
OVER_CHANCE = 1.05


@dataclass
class ByteNet:
    """Weights of the network; ``languages`` names its outputs."""

    languages: list[str]
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # _WIDE * DIM x filters
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        """Narrow filters have no weights past their width."""
        m = np.zeros((_WIDE, DIM, len(WIDTHS), FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            m[:w, :, i] = 1
        return m.reshape(_WIDE * DIM, -1)

    @staticmethod
    def start(languages: list[str], seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return ByteNet(languages, draw(256, DIM, scale=0.5), draw(_WIDE * DIM, n, scale=0.25) * ByteNet.mask(), np.zeros(n, np.float32), draw(n, len(languages), scale=0.1), np.zeros(len(languages), np.float32))

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """The vectors under each filter position: windows x positions x (_WIDE * DIM)."""
        vectors = self.embed[windows]
        n, length, _ = vectors.shape
        s = vectors.strides
        view = np.lib.stride_tricks.as_strided(vectors, (n, length - _WIDE + 1, _WIDE * DIM), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        columns = self.columns(windows)
        n, positions, wide = columns.shape
        answers = (columns.reshape(-1, wide) @ self.filters).reshape(n, positions, -1)
        return columns, answers

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        _, answers = self.pooled(windows)
        hidden = np.maximum(answers.max(axis=1) + self.shift, 0)
        return _softmax(hidden @ self.out + self.bias)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7, epochs: int = 6, batch: int = 64, rate: float = 4e-3) -> ByteNet:
    """Adam on the cross entropy, classes weighted by their rarity."""
    net = ByteNet.start(languages, seed)
    mask = ByteNet.mask()
    rng = np.random.default_rng(seed + 1)
    counts = np.bincount(labels, minlength=len(languages))
    weight = (len(labels) / np.maximum(counts, 1) / len(languages)).astype(np.float32)
    names = ("embed", "filters", "shift", "out", "bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows], labels[rows]
            columns, answers = net.pooled(x)
            best = answers.argmax(axis=1)
            top = np.take_along_axis(answers, best[:, None], axis=1)[:, 0] + net.shift
            hidden = np.maximum(top, 0)
            p = _softmax(hidden @ net.out + net.bias)
            p[np.arange(len(y)), y] -= 1
            d = p * weight[y][:, None] / len(y)
            grad = {"out": hidden.T @ d, "bias": d.sum(axis=0)}
            dh = (d @ net.out.T) * (top > 0)
            grad["shift"] = dh.sum(axis=0)
            under = columns[np.arange(len(y))[:, None], best]  # rows x filters x wide
            grad["filters"] = np.einsum("nf,nfk->kf", dh, under) * mask
            back = dh[:, :, None] * net.filters.T[None]
            where = x[np.arange(len(y))[:, None, None], best[:, :, None] + np.arange(_WIDE)]
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], where.reshape(-1), back.reshape(-1, DIM))
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    return net


def cut(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: first byte, bytes held, and the text; an empty text has one window."""
    size = np.diff(offsets)
    number = np.maximum(-(-size // WINDOW), 1)
    owner = np.repeat(np.arange(len(size)), number)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    start = offsets[owner] + inner * WINDOW
    return start, np.minimum(WINDOW, offsets[owner + 1] - start), owner


def fill(buffer: np.ndarray, start: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The windows' bytes, filled up with blanks."""
    index = start[:, None] + np.arange(WINDOW)
    out = np.where(np.arange(WINDOW) < held[:, None], buffer[np.minimum(index, max(len(buffer) - 1, 0))] if len(buffer) else 32, 32)
    return out.astype(np.uint8)


def learn(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts: int = TRAIN_TEXTS, seed: int = 7) -> ByteNet | None:
    """Fit on at most ``texts`` labelled rows, about as many of each language, chosen by a hash of
    their key; three windows of each, at seeded places. Any number of languages may be labelled:
    those that are met among the chosen rows are learned. None if nothing is labelled."""
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    shown = written(rows.groupBy(F.col(lang).alias("__lang")).agg(F.count(F.lit(1)).alias("__n")), "languages", small=True)
    kinds = shown.count()
    if not kinds:
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 30))
    n = F.length(text)
    places = [F.substring(text, F.pmod(F.xxhash64(F.lit(i), F.col(key).cast("string")), F.greatest(n - WINDOW, F.lit(1))).cast("int") + 1, F.lit(WINDOW)) for i in range(3)]
    parts = rows.select(F.col(lang).alias("lang"), draw.alias("draw"), F.array(*places).alias("parts")).join(shown, F.col("lang") == F.col("__lang"))
    chosen = parts.filter(F.col("draw") < F.lit(1.2 * texts / kinds * (1 << 30)) / F.col("__n")).select("lang", "draw", "parts")
    got = chosen.orderBy("draw", "lang", "parts").limit(texts).collect()
    languages = sorted({r["lang"] for r in got})
    rng = np.random.default_rng(seed)
    windows, labels = [], []
    for r in got:
        for i, part in enumerate(r["parts"]):
            raw = part.encode()[:WINDOW]
            if i == 2:  # short texts are met too
                raw = raw[: int(rng.integers(8, WINDOW))]
            windows.append(raw.ljust(WINDOW, b" "))
            labels.append(languages.index(r["lang"]))
    if not windows:
        return None
    return train(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array(labels), languages, seed)


def identify(df: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1); columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if there is no
    network. Only the text enters the prediction.
    """
    df = df.drop("lang_pred", "score")
    if net is None:
        return df.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    flagged = df.withColumn("__letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    names = df.columns

    def run(batches):
        for batch in batches:
            for part, buffer, offsets in pieces(batch, text):
                start, held, owner = cut(buffer, offsets)
                total = np.zeros((part.num_rows, len(net.languages)))
                for at in range(0, len(start), _BATCH):
                    s = slice(at, at + _BATCH)
                    p = net.probabilities(fill(buffer, start[s], held[s]))
                    np.add.at(total, owner[s], p * np.maximum(held[s], 1)[:, None])
                total /= total.sum(axis=1, keepdims=True)
                letter = np.asarray(part.column("__letter").cast(pa.int8())).astype(bool)
                best = total.argmax(axis=1)
                score = np.where(letter, np.clip(total[np.arange(len(best)), best], 0, 1), 0.0)
                lang = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return flagged.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that are never learned from: crc32 of the key's text leaves 1 when divided by 3."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 3 == 1


def op4_byte_network(spark, sf_dir: str) -> DataFrame:
    """The language of every document; a null doc_id is neither held out nor learned from."""
    docs = table(spark, sf_dir, "documents")
    net = learn(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), net)
    return few_files(found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"))


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any recognisable language go: null texts, texts without a
    letter, and texts that the network cannot place: to which it gives all languages about the same
    probability, none more than ``OVER_CHANCE`` times chance. A network that knows one language
    places everything. If nothing is labelled, so that none can be trained, the first two kinds go."""
    net = learn(docs.filter(~held_out()))
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    kinds = len(net.languages)
    placed = (F.col("lang_pred") != UNKNOWN) & (F.col("score") > (OVER_CHANCE / kinds if kinds > 1 else 0))
    return filtered_apart(docs, ("lang_pred", "score"), lambda d: identify(d, net).filter(placed))
