"""Click totals: per enrolment, per activity type, and the joins around them.

The fact table is aggregated before anything is joined to the enrolments, and
all per-type totals come from one conditional aggregate, so the clickstream is
read and shuffled once whatever the number of activity types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortpulse.functions.columns import identifier, literal
from cohortpulse.schemas import ENROLMENT_KEYS, click_column

MATCHED = "_matched"
HASHED = "_hashed"
NULL_TYPES = "_null_types"
BITS = 63


def with_activity_type(
    clicks: DataFrame,
    vle: DataFrame,
    site: str = "id_site",
    activity: str = "activity_type",
) -> DataFrame:
    """Clicks with the activity type of their site; null for an unknown site.

    No broadcast is forced: the resource table grows with the data, so Spark
    compares its size with the broadcast threshold and otherwise sort-merges,
    where adaptive execution splits the partitions of a hot site.
    """
    return clicks.join(vle.select(site, activity), site, "left")


def activity_vocabulary(
    vle: DataFrame, activity: str = "activity_type", limit: int = 1000
) -> list[str]:
    """Distinct activity types, sorted; refuses to collect beyond ``limit``."""
    rows = vle.select(activity).where(F.col(activity).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} activity types; pass a vocabulary")
    return sorted(r[0] for r in rows)


def activity_types(vle: DataFrame, activity: str = "activity_type") -> DataFrame:
    """Distinct non-null activity types as a table."""
    return vle.select(activity).where(F.col(activity).isNotNull()).distinct()


def activity_counts(
    clicks: DataFrame,
    vle: DataFrame,
    site: str = "id_site",
    weight: str = "sum_click",
    activity: str = "activity_type",
) -> DataFrame:
    """Interaction rows and clicks per activity type, the null type included.

    Rows are counted per site first, so a hot site reaches the join as one row
    per map task rather than as its share of the whole fact table.
    """
    per_site = clicks.groupBy(site).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(weight).alias("n_clicks")
    )
    return (
        with_activity_type(per_site, vle, site, activity)
        .groupBy(activity)
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_clicks").alias("n_clicks"))
    )


def total_clicks(
    clicks: DataFrame, keys: Sequence[str] = ENROLMENT_KEYS, weight: str = "sum_click"
) -> DataFrame:
    """Sum of clicks per enrolment; null where every click count is null."""
    return clicks.groupBy(*keys).agg(F.sum(weight).alias("total_clicks"))


def clicks_of_type(
    clicks: DataFrame,
    vle: DataFrame,
    activity_type: str,
    keys: Sequence[str] = ENROLMENT_KEYS,
    site: str = "id_site",
    weight: str = "sum_click",
    activity: str = "activity_type",
) -> DataFrame:
    """Sum of clicks per enrolment on one activity type.

    The type filter reaches the resource scan, and the inner join drops every
    other row before the shuffle on the enrolment.
    """
    sites = vle.where(F.col(activity) == activity_type).select(site)
    return (
        clicks.select(*keys, site, weight)
        .join(sites, site)
        .groupBy(*keys)
        .agg(F.sum(weight).alias(click_column(activity_type)))
    )


def type_total_aggregates(
    vocabulary: Sequence[str], weight: str = "sum_click", activity: str = "activity_type"
) -> list[Column]:
    """Aggregates for every type, to be placed in one ``groupBy``.

    A type that an enrolment never touched becomes 0, one whose counts are all
    null becomes null. Bit masks of the types seen with a null count tell the
    two apart with one long per 63 types instead of a counter per type.
    """
    kind, value = identifier(activity), identifier(weight)
    sums = [
        F.expr(f"sum(case when {kind} = {literal(t)} then {value} end) as {identifier(click_column(t))}")
        for t in vocabulary
    ]
    masks = []
    for block in range(0, len(vocabulary), BITS):
        bits = " ".join(
            f"when {literal(t)} then {1 << i}L" for i, t in enumerate(vocabulary[block : block + BITS])
        )
        seen = f"case when {value} is null then case {kind} {bits} end end"
        masks.append(F.expr(f"bit_or({seen}) as {NULL_TYPES}{block // BITS}"))
    return sums + masks


def finish_type_totals(df: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """Resolve untouched types to 0 and drop the masks."""
    totals = {click_column(t): i for i, t in enumerate(vocabulary)}
    chosen = []
    for name in df.columns:
        total = identifier(name)
        if name in totals:
            i = totals[name]
            all_null = f"coalesce({NULL_TYPES}{i // BITS}, 0L) & {1 << (i % BITS)}L"
            total = f"case when {total} is not null then {total} when {all_null} = 0 then 0L end as {total}"
        if not name.startswith(NULL_TYPES):
            chosen.append(total)
    return df.selectExpr(*chosen)


def clicks_by_type(
    clicks: DataFrame,
    vle: DataFrame,
    vocabulary: Sequence[str],
    keys: Sequence[str] = ENROLMENT_KEYS,
    site: str = "id_site",
    weight: str = "sum_click",
    activity: str = "activity_type",
) -> DataFrame:
    """One column of click totals per activity type, in a single pass."""
    typed = with_activity_type(clicks.select(*keys, site, weight), vle, site, activity)
    totals = typed.groupBy(*keys).agg(*type_total_aggregates(vocabulary, weight, activity))
    return finish_type_totals(totals, vocabulary)


def clicks_by_type_long(
    clicks: DataFrame,
    vle: DataFrame,
    keys: Sequence[str] = ENROLMENT_KEYS,
    site: str = "id_site",
    weight: str = "sum_click",
    activity: str = "activity_type",
) -> DataFrame:
    """Sum of clicks per enrolment and activity type it touched, a row each.

    The form of :func:`clicks_by_type` for any number of types: no vocabulary is collected
    and the plan does not grow with it. A type whose counts are all null has a null sum.
    """
    typed = with_activity_type(clicks.select(*keys, site, weight), vle, site, activity)
    return typed.where(F.col(activity).isNotNull()).groupBy(*keys, activity).agg(F.sum(weight).alias("total_clicks"))


def clicks_by_type_map(
    totals: DataFrame, keys: Sequence[str] = ENROLMENT_KEYS, activity: str = "activity_type", total: str = "total_clicks"
) -> DataFrame:
    """One map per enrolment from the long form: activity type to clicks, types in order.

    A second level of aggregation: an enrolment sends one entry per type it touched,
    however many clicks it has.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(activity).alias("type"), F.col(total).alias("clicks"))))
    return totals.groupBy(*keys).agg(F.map_from_entries(entries).alias("clicks_by_type"))


def clicks_on(activity_type: str, clicks: str = "clicks_by_type") -> Column:
    """Clicks on one type from a map: 0 if it was not touched, null if all its counts are."""
    kind = F.lit(activity_type)
    return F.when(F.map_contains_key(clicks, kind), F.element_at(clicks, kind)).otherwise(F.lit(0))


def with_default_columns(
    df: DataFrame, columns: Sequence[str], default: int = 0, kind: str = "int"
) -> DataFrame:
    """Add constant columns."""
    return df.withColumns({c: F.lit(default).cast(kind) for c in columns})


def left_join_totals(
    info: DataFrame, totals: DataFrame, keys: Sequence[str], unique_info: bool = True
) -> DataFrame:
    """Left join one row per key onto enrolments.

    Aggregated totals are already partitioned by the keys, so only the
    enrolments move. That is right as long as the keys are the primary key they
    are declared to be. If they may repeat (``unique_info`` false), a key can be
    hot: a hash of the keys as one more join key makes Spark exchange both
    sides, and adaptive execution splits only partitions it has exchanged.
    """
    on = list(keys)
    if unique_info:
        return info.join(totals, on, "left")
    mark = {HASHED: F.xxhash64(*on)}
    return info.withColumns(mark).join(totals.withColumns(mark), [*on, HASHED], "left").drop(HASHED)


def attach_totals(
    info: DataFrame,
    totals: DataFrame,
    keys: Sequence[str] = ENROLMENT_KEYS,
    defaults: Sequence[str] | None = None,
    unique_info: bool = True,
) -> DataFrame:
    """Left join per-enrolment values; 0 without a match, as-is with one.

    A matched null stays null, which is why a match marker decides and not
    ``coalesce``. ``defaults`` names the columns that fall back to 0 (all value
    columns when omitted); the others stay null without a match.
    """
    values = [c for c in totals.columns if c not in keys]
    zero = set(values if defaults is None else defaults)
    joined = left_join_totals(info, totals.withColumn(MATCHED, F.lit(True)), keys, unique_info)
    chosen = []
    for c in joined.columns:
        value = identifier(c)
        if c in zero:
            value = f"case when {MATCHED} is not null then {value} else 0L end as {value}"
        if c != MATCHED:
            chosen.append(value)
    return joined.selectExpr(*chosen)
