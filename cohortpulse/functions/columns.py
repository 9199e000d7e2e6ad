"""Column expressions: keys, lookups, labels, name clean-up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortpulse.schemas import (
    DEGREE_FLAGS,
    DEPRIVATION_DECILES,
    DISTINCTION,
    PRESENTATION_GROUPS,
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_key(*parts: str | Column, separator: str = "-") -> Column:
    """Parts as text with a separator; null as soon as one part is null."""
    pieces: list[Column] = []
    for part in parts:
        if pieces and separator:
            pieces.append(F.lit(separator))
        pieces.append(_col(part).cast("string"))
    return F.concat(*pieces)


def student_module_pres(
    student: str = "id_student",
    module: str = "code_module",
    presentation: str = "code_presentation",
) -> Column:
    return joined_key(student, module, presentation)


def module_pres(module: str = "code_module", presentation: str = "code_presentation") -> Column:
    return joined_key(module, presentation)


def student_and_module(student: str = "id_student", module: str = "code_module") -> Column:
    return joined_key(student, module, separator="")


def identifier(name: str) -> str:
    """Column name for use in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str | int) -> str:
    """Constant for use in SQL text."""
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(key: str, mapping: Mapping[str, int | str]) -> Column:
    """Constant map lookup inside the projection; null for an unknown key.

    ``key`` is SQL text. The map is a literal of fixed size, so there is neither
    a join nor anything to broadcast that could grow.
    """
    entries = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in mapping.items())
    return F.expr(f"map({entries})[{key}]")


def presentation_group(
    module: str = "code_module", presentation: str = "code_presentation"
) -> Column:
    """Group number 0..12 of a module run; null where the run is not listed."""
    return lookup(f"concat({identifier(module)}, '-', {identifier(presentation)})", PRESENTATION_GROUPS)


def deprivation_decile(band: str = "imd_band") -> Column:
    return lookup(identifier(band), DEPRIVATION_DECILES)


def degree_flag(education: str = "highest_education") -> Column:
    return lookup(identifier(education), DEGREE_FLAGS)


def distinction_label(result: str | Column = "final_result") -> Column:
    """1 for a distinction, otherwise 0; an unknown result counts as 0."""
    return F.when(_col(result) == DISTINCTION, F.lit(1)).otherwise(F.lit(0))


def clean_name(name: str) -> str:
    """Column name without the characters tree libraries reject."""
    return name.replace(" ", "_").replace("<=", "+").replace(",", "")


def percentage(share: Column, digits: int = 4) -> Column:
    """Share rounded half-even to ``digits`` places, then scaled to per cent."""
    return F.lit(100.0) * F.bround(share, digits)
