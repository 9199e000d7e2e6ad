"""Mixing sources to target weights by temperature, realised as block permutations.

A source's weight is its share of tokens to the power 1/T, normalised. The exponent is
found by bisection: the smallest one that keeps every source within a limit of passes
over its documents, or the one whose weights reach an entropy. The budget of tokens
is what lets the most shortened source have one whole pass, unless it is given; so by
default every document is used at least once and small sources are repeated.

A source's documents are dealt into ``BLOCKS`` blocks. Each pass visits the blocks in
an order of its own, and the last pass ends where the source's share of the budget is
spent. A document's place within its block is a hash, so running sums go over blocks
only, never over a source's rows, and a source that holds most rows is spread over its
blocks. All sources advance evenly through the mixture: at any point of it they have
contributed tokens in proportion to their weights.

Null and empty sources are one source. Null and empty texts count one token, the
document end. Repeated rows are documents of their own, at one place. An empty table gives an empty
result. Other columns, whatever their names, are kept by ``mixed`` and play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortpulse.llm.common import map_rows, stored, table
from cohortpulse.llm.tokens import encoder, vocabulary_path

BLOCKS = 1024
SEED = 17
MARK = "__mark"
#: Passes over a source's documents that the registered query and the pipeline allow.
PASSES = 1.5
#: Exponents that one aggregate tries, and how often their range is cut.
PARTS = 32
STEPS = 9


def weights(totals: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised weights: shares of tokens to the power of the exponent."""
    most = max(totals.values(), default=1)
    raised = {s: (n / most) ** exponent for s, n in totals.items() if n > 0}
    whole = math.fsum(raised.values())
    return {s: x / whole for s, x in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    return -math.fsum(p * math.log(p) for p in shares.values() if p > 0)


def bisect(good: Callable[[float], bool], steps: int = 60) -> float:
    """Smallest exponent in [0, 1] that is good, where larger ones are too."""
    low, high = 0.0, 1.0
    if good(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def passes(totals: dict[str, int], exponent: float, budget: float | None = None) -> dict[str, float]:
    """How often each source's documents are gone through."""
    share = weights(totals, exponent)
    if budget is None:
        budget = max((totals[s] / p for s, p in share.items()), default=0.0)
    return {s: p * budget / totals[s] for s, p in share.items()}


def exponent_for(totals: dict[str, int], most_passes: float | None = None, target_entropy: float | None = None, budget: float | None = None) -> float:
    """Exponent of the token shares that meets a limit of passes or an entropy.

    Entropy falls as the exponent grows, so a target beyond what the shares can give
    ends at the nearer bound, 0 (all sources alike) or 1 (their own shares).
    """
    if (most_passes is None) == (target_entropy is None):
        raise ValueError("state either a limit of passes or an entropy")
    if not totals:
        return 1.0
    if most_passes is not None:
        return bisect(lambda x: max(passes(totals, x, budget).values()) <= most_passes * (1 + 1e-12))
    return bisect(lambda x: entropy(weights(totals, x)) <= target_entropy)


def _sums(totals: DataFrame, most: float, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent x the sums of r^x and of r^x ln r, r being a source's total as a
    share of the largest: one small aggregate, whatever the number of sources."""
    r = F.col("total") / most
    powers = [F.pow(r, F.lit(float(x))) for x in exponents]
    row = totals.agg(*[F.sum(p) for p in powers], *[F.sum(p * F.ln(r)) for p in powers]).first()
    values = [v or 1.0 if k < len(exponents) else v or 0.0 for k, v in enumerate(row)]
    return list(zip(values[: len(exponents)], values[len(exponents) :]))


def _exponent(totals: DataFrame, most: float, least: float, most_passes: float | None, target_entropy: float | None, budget: float | None) -> float:
    """:func:`exponent_for` over a table of totals: every step cuts the range of the
    exponent into ``PARTS`` parts, all evaluated by one aggregate.

    A source of share r has weight r^x over the sum of all. The smallest one is gone
    through most often, and without a budget the largest exactly once, which leaves its
    ratio to it, and the entropy of the weights follows from the two sums.
    """
    if (most_passes is None) == (target_entropy is None):
        raise ValueError("state either a limit of passes or an entropy")

    def good(x: float, whole: float, logs: float) -> bool:
        if most_passes is None:
            return math.log(whole) - x * logs / whole <= target_entropy
        once = 1.0 if budget is None else budget / (most * whole)
        return once * (least / most) ** (x - 1) <= most_passes * (1 + 1e-12)

    low, high = 0.0, 1.0
    for _ in range(STEPS):
        points = [low + (high - low) * k / PARTS for k in range(PARTS)]
        holds = [good(x, *sums) for x, sums in zip(points, _sums(totals, most, points))]
        if not any(holds):
            low = points[-1]
            continue
        first = holds.index(True)
        if not first:
            return points[0]
        low, high = points[first - 1], points[first]
    return high


def source_of(source_col: str) -> Column:
    return F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))


def _mark() -> Column:
    """What a row is known by in every scan, however its files are cut: repeated rows go
    together."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _block(seed: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(MARK)), F.lit(blocks)).cast("int")


def block_tokens(docs: DataFrame, vocabulary: str, source_col: str = "source", blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """Tokens of each block of each source, document ends included."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for source, block, text in rows:
            yield source, block, encoder(vocabulary).count(text) + 1

    given = _sourced(docs, source_col)
    counted = map_rows(
        given.select("source", _block(seed, blocks).alias("block"), "text"), run,
        pa.schema([("source", pa.string()), ("block", pa.int32()), ("n", pa.int64())]), "source string, block int, n long",
    )
    return counted.groupBy("source", "block").agg(F.sum("n").alias("n"))


def _sourced(docs: DataFrame, source_col: str) -> DataFrame:
    """Id, source, UTF-8 bytes and mark of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_of(source_col).alias("source"),
        _mark().alias(MARK),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def schedule(blocks: DataFrame, most_passes: float | None = PASSES, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """Where each pass over each stored block lies in its source's share:
    ``source, block, pass, start, n, share`` in tokens."""
    totals = stored(blocks.groupBy("source").agg(F.sum("n").alias("total")).filter("total > 0"), "totals")
    extent = totals.agg(F.max("total").alias("most"), F.min("total").alias("least")).first()
    most, least = float(extent["most"] or 1), float(extent["least"] or 1)
    exponent = _exponent(totals, most, least, most_passes, target_entropy, budget)
    whole, _ = _sums(totals, most, [exponent])[0]
    share = F.col("total") / most
    weight = F.pow(share, F.lit(exponent)) / whole
    # without a budget the largest source has exactly one pass, and no other fewer
    rate = F.pow(share, F.lit(exponent - 1)) if budget is None else weight * float(budget) / F.col("total")
    plan = totals.select("source", "total", rate.alias("passes"), weight.alias("weight"))
    order = Window.partitionBy("source", "pass").orderBy(F.xxhash64(F.lit(seed), "source", "pass", "block"), "block")
    visits = blocks.join(plan, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes") - 1, F.lit(0)).cast("int"))))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = visits.withColumn("start", F.col("pass") * F.col("total") + before).withColumn("share", F.col("passes") * F.col("total"))
    return placed.filter("start < share").select("source", "block", "pass", "start", "n", "share", "weight")


def _visits(given: DataFrame, plan: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Rows of ``given`` once per pass that reaches them, with their ``position``."""
    within = (F.xxhash64(F.lit(seed + 1), F.col(MARK), F.col("pass")).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    spot = F.col("start") + within * F.col("n")
    rows = given.withColumn("block", _block(seed, blocks)).join(plan, ["source", "block"])
    return rows.withColumn("spot", spot).filter("spot < share").withColumn("position", F.col("spot") / F.col("share"))


def mixture(docs: DataFrame, vocabulary: str, source_col: str = "source", blocks: int = BLOCKS, seed: int = SEED, **target) -> DataFrame:
    """One row per use of a document: ``doc_id, source, pass, position, weight``;
    the mixture is read in ascending ``position``."""
    given = _sourced(docs, source_col)
    plan = schedule(stored(block_tokens(docs, vocabulary, source_col, blocks, seed), "blocks"), seed=seed, **target)
    return _visits(given.drop("text"), plan, blocks, seed).select("doc_id", "source", "pass", "position", "weight")


def mixed(docs: DataFrame, vocabulary: str, source_col: str = "source", blocks: int = BLOCKS, seed: int = SEED, **target) -> DataFrame:
    """The documents themselves in mixture order, repeated as the passes ask."""
    plan = schedule(stored(block_tokens(docs, vocabulary, source_col, blocks, seed), "blocks"), seed=seed, **target)
    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"),
        F.col("doc_id").cast("long").alias("doc_id"),
        source_of(source_col).alias("source"),
        _mark().alias(MARK),
    )
    return _visits(given, plan, blocks, seed).orderBy("position", "doc_id", MARK).select("whole.*")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), vocabulary_path())
