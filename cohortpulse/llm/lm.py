"""Language-model scoring by the difference of two cross-entropies.

A target and a background n-gram model share one vocabulary, the token ids of a public
tokenizer, and one form: bigrams smoothed by the model's own unigrams. They are matched
in size as well: the background's counts are scaled to the target's total, since a model
of more text would win by its weaker smoothing. A document's score is the mean, over its tokens, of the target's loss less the background's: the
lower, the more it reads like the target. The target is what ``labels`` marks good and
the background is every document.

Counts cover all documents and are exact. Texts are encoded once and written in chunks of
about ``CHUNK`` tokens. Each chunk's distinct bigrams are counted in the chunk, then summed
by bigram in a shuffle into a stored table, which grows with the corpus. To score, each
chunk's distinct bigrams are joined to those sums and meet their chunk in a second shuffle:
a bigram comes once per chunk however frequent it is, and a task holds one chunk with its
counts; there are as many tasks as chunks, up to ``MOST_TASKS``. Only the unigrams, one pair of numbers per vocabulary entry, reach the driver.

Null and empty texts have the document end alone and are scored on it. Repeated rows
count and are scored once each. A document with several labels is a target if any says
so; null labels say nothing. Without a target every difference is zero.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import rows_of, stored, table
from cohortpulse.llm.tokens import END, document_ids, encoder, vocabulary_path

#: Ids of the default vocabulary lie below this number; see :func:`ids_below`.
IDS = 49_408
#: Cells of all its bigrams, one for each; those of single tokens come after them.
CELLS = IDS * IDS
#: Weight of the unigrams in a bigram's probability, in counts.
PRIOR = 20.0
#: Tokens and documents at which a chunk ends; a document is never cut.
CHUNK = 1 << 21
MOST_DOCUMENTS = 1 << 16
#: Tasks that chunks are scored in; a task takes its chunks one after the other.
MOST_TASKS = 100_000

_CHUNKS = pa.schema(
    [("chunk", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("targets", pa.list_(pa.bool_())), ("ids", pa.binary())]
)
_CHUNKS_DDL = "chunk string, doc_ids array<long>, sizes array<long>, targets array<boolean>, ids binary"
_SCORES_DDL = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"


def ids_below(vocabulary: str) -> int:
    """Number above all ids of a vocabulary file and the document end."""
    held = encoder(vocabulary).tokenizer.get_vocab(with_added_tokens=True)
    return max([END, *held.values()]) + 1


def _id_type(n_ids: int) -> str:
    """Integer type in which chunks hold ids."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def cells_of(ids: np.ndarray, sizes: np.ndarray, n_ids: int = IDS) -> np.ndarray:
    """Cell of each token with the one before it; a document starts after its end."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = END
    return before * n_ids + ids


def chunked(docs: DataFrame, vocabulary: str, chunk: int = CHUNK) -> DataFrame:
    """Token ids of all texts, a chunk in each row. ``docs`` has ``doc_id``, ``text`` as
    bytes and ``is_target``; the chunks' names hold once the result is stored."""
    width = _id_type(ids_below(vocabulary))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def row() -> pa.RecordBatch:
            docs, targets, ids = zip(*held, strict=True)
            columns = [[uuid.uuid4().hex], [docs], [[len(i) for i in ids]], [targets], [np.concatenate(ids).astype(width).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNKS)], schema=_CHUNKS)

        for doc_id, text, is_target in rows_of(stream):
            ids = document_ids(vocabulary, text)
            held.append((doc_id, is_target, ids))
            total += len(ids)
            if total >= chunk or len(held) >= MOST_DOCUMENTS:
                yield row()
                held, total = [], 0
        if held:
            yield row()

    return docs.select("doc_id", "text", "is_target").mapInArrow(run, _CHUNKS_DDL)


def pairs_of(chunks: DataFrame, n_ids: int = IDS) -> DataFrame:
    """``chunk, cell, target, background``: each stored chunk's distinct bigrams, counted."""
    schema = pa.schema([("chunk", pa.string()), ("cell", pa.int64()), ("target", pa.int64()), ("background", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, sizes, targets, ids in rows_of(stream, 1):
            sizes = np.array(sizes, np.int64)
            cells, which = np.unique(cells_of(np.frombuffer(ids, _id_type(n_ids)).astype(np.int64), sizes, n_ids), return_inverse=True)
            background = np.bincount(which)
            target = np.bincount(which[np.repeat(np.array(targets, bool), sizes)], minlength=len(cells))
            for at in range(0, len(cells), 65536):
                part = [pa.array(c[at : at + 65536]) for c in (cells, target, background)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part[0]), pa.string()), *part], schema=schema)

    return chunks.select("chunk", "sizes", "targets", "ids").mapInArrow(run, "chunk string, cell long, target long, background long")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def _singles(pairs: DataFrame, n_ids: int) -> DataFrame:
    """Counts of single tokens, each of which ends one bigram."""
    return _summed(pairs.withColumn("cell", F.lit(n_ids * n_ids) + F.col("cell") % n_ids))


def counted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``cell, target, background``: cells below the vocabulary's square count bigrams, those
    from there on single tokens. ``docs`` has ``doc_id``, ``text`` as bytes and ``is_target``."""
    n_ids = ids_below(vocabulary)
    pairs = stored(_summed(pairs_of(stored(chunked(docs, vocabulary), "chunks"), n_ids)), "bigrams")
    return pairs.union(_singles(pairs, n_ids))


@dataclass
class Formula:
    """Losses of tokens from their cells and their cells' counts, for the tasks."""

    singles: np.ndarray
    alone: np.ndarray
    scale: float

    def __call__(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        before, ids = np.divmod(cells, len(self.singles))
        return -np.log((counts * self.scale + PRIOR * self.alone[ids]) / (self.singles[before] + PRIOR))


class Bigrams:
    """Log-probabilities of tokens after their predecessors, from counts: ``pairs`` is
    the stored table of all bigrams' counts and ``column`` the model's own."""

    def __init__(self, pairs: DataFrame, column: str, singles: np.ndarray, scale: float = 1.0):
        self.pairs, self.column, self.scale = pairs, column, scale
        self.singles = singles * scale
        self.alone = (self.singles + 1) / (self.singles.sum() + len(singles))

    def formula(self) -> Formula:
        return Formula(self.singles, self.alone, self.scale)

    def losses(self, ids: np.ndarray) -> np.ndarray:
        """Losses of one text's tokens, looked up from the driver."""
        cells = cells_of(ids.astype(np.int64), np.array([len(ids)]), len(self.singles))
        wanted = self.pairs.sparkSession.createDataFrame([(c,) for c in set(cells.tolist())], "cell long")
        held = {r["cell"]: r[self.column] for r in self.pairs.join(wanted, "cell").collect()}
        return self.formula()(cells, np.array([held.get(c, 0) for c in cells.tolist()]))


def flagged(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Id and bytes of every text, and whether its id is among ``targets`` (doc_id)."""
    named = targets.select("doc_id").filter("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    # the same plan at every size: texts meet their labels in a shuffle, without a sort
    return given.join(named.hint("shuffle_hash"), "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def fitted(pairs: DataFrame, n_ids: int = IDS) -> tuple[Bigrams, Bigrams]:
    """Target and background model of one form, vocabulary and size, from stored counts."""
    rows = _singles(pairs, n_ids).toArrow()
    held = np.zeros((2, n_ids), np.int64)
    where = rows["cell"].to_numpy() - n_ids * n_ids
    held[0, where], held[1, where] = rows["target"].to_numpy(), rows["background"].to_numpy()
    target, background = held.sum(axis=1).tolist()
    scale = target / background if background else 0.0
    return Bigrams(pairs, "target", held[0]), Bigrams(pairs, "background", held[1], scale)


def models(docs: DataFrame, targets: DataFrame, vocabulary: str) -> tuple[Bigrams, Bigrams]:
    """Both models, from ``docs`` and the ids of its targets."""
    chunks = stored(chunked(flagged(docs, targets), vocabulary), "chunks")
    n_ids = ids_below(vocabulary)
    return fitted(stored(_summed(pairs_of(chunks, n_ids)), "bigrams"), n_ids)


def scored_chunks(chunks: DataFrame, pairs: DataFrame, target: Bigrams, background: Bigrams) -> DataFrame:
    """Scores of the texts of stored ``chunks``, whose ``pairs`` are from :func:`pairs_of`."""
    sent = chunks.sparkSession.sparkContext.broadcast((target.formula(), background.formula()))
    n_ids = len(target.singles)
    tasks = max(1, min(chunks.count(), MOST_TASKS))
    counts = pairs.select("chunk", "cell").join(target.pairs, "cell", "left").repartition(tasks, "chunk")
    texts = chunks.select("chunk", "doc_ids", "sizes", "ids").repartition(tasks, "chunk")

    def run(given: pa.Table, found: pa.Table) -> pa.Table:
        ours, theirs = sent.value
        held = [found[c].to_numpy() for c in ("cell", "target", "background")]
        order = np.argsort(held[0])
        known, a, b = (np.nan_to_num(c[order]) for c in held)
        out = []
        for row in given.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            cells = cells_of(np.frombuffer(row["ids"], _id_type(n_ids)).astype(np.int64), sizes, n_ids)
            at, starts = np.searchsorted(known, cells), np.cumsum(sizes) - sizes
            one, other = (np.add.reduceat(f(cells, n[at]), starts) / sizes for f, n in ((ours, a), (theirs, b)))
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": sizes, "target_loss": one, "background_loss": other, "difference": one - other}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in _SCORES})

    return texts.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(run, _SCORES_DDL)


_SCORES = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("difference", pa.float64())]


def scored(docs: DataFrame, target: Bigrams, background: Bigrams, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, difference`` of every text."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    chunks = stored(chunked(given.withColumn("is_target", F.lit(False)), vocabulary), "chunks")
    return scored_chunks(chunks, pairs_of(chunks, ids_below(vocabulary)), target, background)


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    good = table(spark, folder, "labels").filter("quality = 1")
    vocabulary = vocabulary_path()
    n_ids = ids_below(vocabulary)
    chunks = stored(chunked(flagged(docs, good), vocabulary), "chunks")
    pairs = stored(pairs_of(chunks, n_ids), "pairs")
    return scored_chunks(chunks, pairs, *fitted(stored(_summed(pairs), "bigrams"), n_ids))
