"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics of a document fall into bins, and its score is a sum of looked-up
numbers, one per feature and one per chosen pair of features, through a logistic
curve. Cyclic boosting learns the tables: round after round each feature in turn gets
a shallow tree on the gradients summed by bin, then each pair one on its two-way bins.
Tables can be read and plotted feature by feature.

The model is fitted in one task on at most ``SAMPLE`` labelled rows, those with the
smallest hash of their id, so more labels do not change its cost; scoring is a pass
over all whole texts without a shuffle. Features come from the text alone.

Null text counts as empty and has a score like any other. Labels that are null are
not learned from; a document with several labels is learned from once per label.
Without labels of both classes the score is their smoothed share. Repeated rows have
equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import operator
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import rows_of, table

#: Most labelled rows that the model is fitted on.
SAMPLE = 12_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 200, 100, 0.1, 1.0

#: Byte classes that are counted, by name.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "symbol": b"!#$%&*+/<=>@\\^_`{|}~",
    "bracket": b"()[]\"'-",
    "blank": b" \t",
    "line": b"\n",
    "beyond": bytes(range(128, 256)),
}
_SIGNS = frozenset(_CLASSES["symbol"])
_MEMBERS = np.array([[b in members for members in _CLASSES.values()] for b in range(256)], np.float64)
NAMES = [
    "log_bytes", "log_words", *(f"share_{k}" for k in _CLASSES), "word_bytes", "distinct_words", "repeated_next",
    "distinct_lines", "line_words", "sign_at_end", "byte_entropy",
]


def features(text: bytes) -> list[float]:
    """Statistics of a whole text; all are defined for the empty one."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    n = max(len(text), 1)
    shares = (counts @ _MEMBERS / n).tolist()
    words = text.split()
    m = max(len(words), 1)
    lines = text.split(b"\n")
    seen = counts[counts > 0] / n
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        *shares,
        sum(map(len, words)) / m,
        len(set(words)) / m,
        sum(map(operator.eq, words, words[1:])) / m,
        len(set(lines)) / len(lines),
        len(words) / len(lines),
        sum(map(_SIGNS.__contains__, (w[-1] for w in words))) / m,
        float(-(seen * np.log2(seen)).sum()),
    ]


def feature_rows(texts: Iterator[bytes]) -> np.ndarray:
    rows = [features(t) for t in texts]
    return np.array(rows, np.float64).reshape(len(rows), len(NAMES))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges at the values' quantiles."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value per bin of a tree of the given depth on binned gradients."""
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + RIDGE) + (g.sum() - a) ** 2 / (h.sum() - b + RIDGE)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9:
            return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + RIDGE))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf value per cell of a two-level tree, one feature above the other, and its gain."""
    best: tuple[float, np.ndarray] = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            leaves = np.empty_like(a)
            gain = 0.0
            for part in (slice(0, cut), slice(cut, None)):
                x, y = a[part].sum(0), b[part].sum(0)
                row = _tree(x, y, 1)
                leaves[part] = row
                gain += float((2 * x * row - (y + RIDGE) * row**2).sum())
            if gain > best[0]:
                best = gain, leaves.T if turned else leaves
    return best[1], best[0]


class Additive:
    """Bin edges and lookup tables; ``score`` adds up what the bins say."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple]):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def margins(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, rows[:, j], side="right")]
        for i, j, x, y, values in self.pairs:
            out += values[np.searchsorted(x, rows[:, i], side="right"), np.searchsorted(y, rows[:, j], side="right")]
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def _gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    return y - p, p * (1 - p)


def fit_rows(rows: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Additive:
    """Model of labels 0 and 1 from feature rows."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Additive(base, [np.empty(0)] * len(NAMES), [np.zeros(1)] * len(NAMES), [])
    edges = [_edges(rows[:, j], BINS) for j in range(rows.shape[1])]
    binned = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), base)
    for _ in range(rounds):
        for bins, values in zip(binned, tables, strict=True):
            g, h = _gradients(margin, y)
            step = RATE * _tree(np.bincount(bins, g, len(values)), np.bincount(bins, h, len(values)), 2)
            values += step
            margin += step[bins]
    # the pairs that would lower the loss most come in
    coarse = [_edges(rows[:, j], PAIR_BINS) for j in range(rows.shape[1])]
    places = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return places[i] * shape[1] + places[j], shape

    def sums(cells: np.ndarray, shape: tuple[int, int]) -> list[np.ndarray]:
        return [np.bincount(cells, v, shape[0] * shape[1]).reshape(shape) for v in _gradients(margin, y)]

    gains = [(_pair_tree(*sums(*grid(i, j)))[1], i, j) for i, j in itertools.combinations(range(rows.shape[1]), 2)]
    chosen = [(i, j, *grid(i, j)) for gain, i, j in sorted(gains, reverse=True)[:pairs] if gain > 0]
    found = [np.zeros(shape) for *_, shape in chosen]
    for _ in range(pair_rounds):
        for (_, _, cells, shape), values in zip(chosen, found, strict=True):
            step = RATE * _pair_tree(*sums(cells, shape))[0]
            values += step
            margin += step.ravel()[cells]
    return Additive(base, edges, tables, [(i, j, coarse[i], coarse[j], v) for (i, j, *_), v in zip(chosen, found, strict=True)])


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Additive:
    """Model of ``label`` from at most ``sample`` labelled rows that are not held out."""
    key = F.col("doc_id")
    usable = labels.select(key, F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & key.isNotNull() & ~held_out(key))
    # at most `sample` rows of two numbers: small enough to send to every task
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def measured(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, y in rows_of(stream):
            yield pa.RecordBatch.from_pydict({"y": pa.array([y], pa.int32()), "x": pa.array([features(text)], pa.list_(pa.float64()))})

    def fitted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(rows_of(stream))
        rows.sort()  # the same model in whatever order rows arrive
        x = np.array([r[1] for r in rows], np.float64).reshape(len(rows), len(NAMES))
        model = fit_rows(x, np.array([r[0] for r in rows], np.float64))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = texts.join(chosen, "doc_id").select("text", "y").mapInArrow(measured, "y int, x array<double>")
    return pickle.loads(rows.repartition(1).mapInArrow(fitted, "model binary").first()["model"])


def scorer(model: Additive):
    """Column function from UTF-8 bytes to a score in [0, 1]."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_rows(t if t is not None else b"" for t in texts)), dtype="float64")

    return lambda text: score(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def keep_good(docs: DataFrame, model: Additive, threshold: float = 0.5) -> DataFrame:
    """Rows whose score reaches the threshold, with all their columns."""
    return docs.filter(scorer(model)(F.col("text")) >= threshold)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
