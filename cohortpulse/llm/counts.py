"""Token counts per field or section by the character spans of tokens.

A document is encoded once as a whole; each token covers a span of its characters.
An interval join then gives tokens to sections, found by bisection since sections of a
document do not overlap. A token that crosses a section's boundary goes by an explicit
rule:

``first``  to the section that holds its first character,
``most``   to the section that holds most of its characters, the earlier one if equal,
``shared`` to every section it touches, in proportion to the characters there.

Characters that no section holds count for none: a token goes to the sections it
touches, whatever lies outside, and ``loose`` counts tokens that touch none. Under
``first`` a token whose first character is in no section is loose.

Null text counts as empty. An empty text has one empty section without tokens.
Repeated rows are documents of their own. Texts of any length are held one at a time.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.llm.common import map_rows, numbered, table
from cohortpulse.llm.tokens import encoder, vocabulary_path

RULES = ("first", "most", "shared")
#: Characters after which a line is cut into further sections.
LONGEST = 1000


def attribute(first: np.ndarray, last: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section and loose tokens, for spans ``[first, last)`` and sorted
    disjoint sections ``[begins, ends)``. A token without characters is a point."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    out = np.zeros(len(begins))
    if not len(first):
        return out, 0
    last = np.maximum(last, first + 1)
    if rule == "first":
        at = np.searchsorted(begins, first, side="right") - 1
        inside = at >= 0
        inside[inside] = first[inside] < ends[at[inside]]
        np.add.at(out, at[inside], 1)
        return out, int((~inside).sum())
    # sections touched by a token are the run from low to high
    low = np.searchsorted(ends, first, side="right")
    high = np.searchsorted(begins, last, side="left")
    touched = np.maximum(high - low, 0)
    single = touched == 1
    np.add.at(out, low[single], 1)
    for k in np.flatnonzero(touched > 1):
        run = np.arange(low[k], high[k])
        share = np.minimum(ends[run], last[k]) - np.maximum(begins[run], first[k])
        if rule == "most":
            out[run[int(np.argmax(share))]] += 1
        elif share.sum() > 0:
            out[run] += share / share.sum()
    return out, int((touched == 0).sum())


def line_sections(text: str, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Lines without their ends, long ones cut every ``longest`` characters."""
    begins, ends, at = [], [], 0
    for line in text.split("\n"):
        cuts = range(at, at + max(len(line), 1), longest)
        begins += cuts
        ends += [min(c + longest, at + len(line)) for c in cuts]
        at += len(line) + 1
    return np.array(begins), np.array(ends)


def section_tokens(
    docs: DataFrame, vocabulary: str, rule: str = "most", sections: Callable[[str], tuple[np.ndarray, np.ndarray]] = line_sections,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, section, first_char, end_char, n_tokens, doc_tokens, loose`` for each
    section of each text; ``sections`` gives sorted disjoint spans of a text."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, doc_id, text in rows:
            ids, first, last = encoder(vocabulary, spans=True).spans(text)
            begins, ends = sections(text.decode())
            found, loose = attribute(first, last, begins, ends, rule)
            for k, (a, b, n) in enumerate(zip(begins.tolist(), ends.tolist(), found.tolist(), strict=True)):
                yield doc_id, k, a, b, n, len(ids), loose

    schema = pa.schema(
        [("doc_id", pa.int64()), ("section", pa.int32()), ("first_char", pa.int64()), ("end_char", pa.int64()),
         ("n_tokens", pa.float64()), ("doc_tokens", pa.int64()), ("loose", pa.int64())]
    )
    ddl = "doc_id long, section int, first_char long, end_char long, n_tokens double, doc_tokens long, loose long"
    return map_rows(numbered(docs, id_col, text_col), run, schema, ddl)


def field_tokens(df: DataFrame, vocabulary: str, id_col: str, fields: list[str], rule: str = "most", between: str = "\n") -> DataFrame:
    """``doc_id, field, n_tokens`` of several text columns that are encoded as one
    text, with ``between`` between them; null fields are empty."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, *values in rows:
            sizes = np.array([len(v) for v in values])
            begins = np.concatenate([[0], np.cumsum(sizes + len(between))[:-1]]).astype(np.int64)
            _, first, last = encoder(vocabulary, spans=True).spans(between.join(values).encode())
            found, _ = attribute(first, last, begins, begins + sizes, rule)
            yield from ((doc_id, name, n) for name, n in zip(fields, found.tolist(), strict=True))

    given = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f"f{k}") for k, f in enumerate(fields)])
    schema = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("n_tokens", pa.float64())])
    return map_rows(given, run, schema, "doc_id long, field string, n_tokens double")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return section_tokens(table(spark, folder, "documents"), vocabulary_path())
