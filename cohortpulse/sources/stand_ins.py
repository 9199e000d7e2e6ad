"""The seven base tables bound to the supplied sales tables.

The study's own data is not at hand, so orders play enrolments, their line
items the clickstream, parts the learning resources and suppliers the
assessments. Every column is derived row by row from the supplied tables and
takes the vocabulary the operators expect, unmapped and missing values included.

Identifiers stay 64-bit, since the supplied keys outgrow an int at scale.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.functions.columns import literal, lookup
from cohortpulse.schemas import ACTIVITY_TYPES, CATEGORIES
from cohortpulse.sources.readers import read_parquet

EDUCATION_OF_SEGMENT = dict(
    zip(
        ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        CATEGORIES["highest_education"],
    )
)


def _pick(values: list[str], index: str) -> Column:
    """Entry of a constant list at a zero-based index, given as SQL text."""
    return F.expr(f"array({', '.join(map(literal, values))})[int({index})]")


def _module(number: Column) -> Column:
    """0 -> AAA up to 6 -> GGG."""
    return F.repeat(F.char(number + 65), 3)


#: Clicks that one task joins and adds up at most, where queries ask for it.
CLICKS_A_TASK = 500_000
#: Up to here adaptive execution decides.
MANY_CLICKS = 8_000_000


def _run(odd_year: Column, first_half: Column) -> Column:
    return F.concat(
        F.when(odd_year, "2013").otherwise("2014"), F.when(first_half, "B").otherwise("J")
    )


@dataclass(frozen=True)
class StandIns:
    """Lazily bound base tables over one folder of supplied tables."""

    spark: SparkSession
    folder: str

    def _read(self, name: str) -> DataFrame:
        return read_parquet(self.spark, self.folder, name)

    def _orders(self) -> DataFrame:
        """Orders with the enrolment keys: weekday is the module, date the run."""
        day = F.col("o_orderdate")
        return self._read("orders").withColumns(
            {
                "id_student": F.col("o_custkey"),
                "code_module": _module(F.dayofweek(day) - 1),
                "code_presentation": _run(F.year(day) % 2 == 1, F.month(day) <= 6),
            }
        )

    @property
    def enrolments(self) -> DataFrame:
        """Enrolment keys alone, for jobs that need no demographics."""
        return self._orders().select(
            F.col("o_orderkey").alias("enrolment_no"), "id_student", "code_module", "code_presentation"
        )

    @property
    def courses(self) -> DataFrame:
        return (
            self._orders()
            .groupBy("code_module", "code_presentation")
            .agg(F.count(F.lit(1)).alias("module_presentation_length"))
        )

    @property
    def student_info(self) -> DataFrame:
        """Enrolments. ``enrolment_no`` settles ties between repeated keys."""
        nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
        month = F.month("o_orderdate")
        decile = F.floor(balance / 1000)
        return (
            self._orders()
            .join(self._read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_orderkey").alias("enrolment_no"),
                "code_module",
                "code_presentation",
                "id_student",
                F.when(nation == 24, None)
                .when(nation % 2 == 0, "F")
                .otherwise("M")
                .alias("gender"),
                # Negative balances take the spelling without a per cent sign.
                F.when(balance < 0, "10-20")
                .otherwise(
                    F.concat((decile * 10).cast("string"), F.lit("-"), (decile * 10 + 10).cast("string"), F.lit("%"))
                )
                .alias("imd_band"),
                lookup("c_mktsegment", EDUCATION_OF_SEGMENT).alias("highest_education"),
                _pick(CATEGORIES["age_band"], "c_nationkey div 10").alias("age_band"),
                F.when(month.isin(5, 6, 11, 12), 1).otherwise(0).alias("number_of_prev_attempts"),
                (F.substring("o_orderpriority", 1, 1).cast("int") * 30).alias("studied_credits"),
                _pick(CATEGORIES["region"], "c_nationkey % 13").alias("region"),
                F.when(balance < 0, "Y").otherwise("N").alias("disability"),
                F.when(F.col("o_orderstatus") == "F", "Distinction")
                .when(F.col("o_orderstatus") == "O", "Pass")
                .alias("final_result"),
            )
        )

    @property
    def vle(self) -> DataFrame:
        """Resources; the largest size has no activity type."""
        size = F.col("p_size")
        return self._read("part").select(
            F.col("p_partkey").alias("id_site"),
            F.when(size < 50, _pick(ACTIVITY_TYPES, "p_size % 20")).alias("activity_type"),
        )

    @property
    def vle_runs(self) -> DataFrame:
        """Resources with the module run they belong to; no run has module HHH."""
        key = F.col("p_partkey")
        return self._read("part").select(
            key.alias("id_site"),
            _module((key % 8).cast("int")).alias("code_module"),
            _run(key % 2 == 0, F.floor(key / 8) % 2 == 0).alias("code_presentation"),
        )

    @property
    def student_registration(self) -> DataFrame:
        """Registrations of the orders: null presentations, and runs of no course."""
        status = F.col("o_orderstatus")
        return self._orders().select(
            "code_module",
            F.when(status == "P", None)
            .when(F.year("o_orderdate") == 1998, "2015B")
            .otherwise(F.col("code_presentation"))
            .alias("code_presentation"),
            "id_student",
            (F.dayofyear("o_orderdate") - 200).alias("date_registration"),
            F.when(status == "F", F.dayofyear("o_orderdate")).alias("date_unregistration"),
        )

    @property
    def student_vle(self) -> DataFrame:
        """Clickstream: one row per line item, days counted from the order."""
        lines, orders = self._lines_and_orders()
        return self._clicks(lines, orders)

    @property
    def dealt_student_vle(self) -> DataFrame:
        """The same in tasks of a bounded number of clicks, where there are many.

        Adaptive execution joins small partitions to about as many tasks as cores, which
        then sort and hold a share of the input each; that matters where sums hardly make
        rows fewer. An order has few lines, so no task gets many more. The number of line
        items comes from the files' footers.
        """
        lines, orders = self._lines_and_orders()
        n = lines.count()
        if n > MANY_CLICKS:
            tasks = ceil(n / CLICKS_A_TASK)
            lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
        return self._clicks(lines, orders)

    def _lines_and_orders(self) -> tuple[DataFrame, DataFrame]:
        lines = self._read("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
        orders = self._orders().select("o_orderkey", "o_orderdate", "id_student", "code_module", "code_presentation")
        return lines, orders

    @staticmethod
    def _clicks(lines: DataFrame, orders: DataFrame) -> DataFrame:
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_partkey").alias("id_site"),
            "id_student",
            "code_module",
            "code_presentation",
            F.datediff("l_shipdate", "o_orderdate").alias("click_date"),
            F.col("l_quantity").cast("int").alias("sum_click"),
        )

    @property
    def assessments(self) -> DataFrame:
        key = F.col("s_suppkey")
        turn = F.floor(key / 7) % 4
        return self._read("supplier").select(
            _module((key % 7).cast("int")).alias("code_module"),
            _run(turn < 2, turn % 2 == 0).alias("code_presentation"),
            key.alias("id_assessment"),
        )

    @property
    def student_assessment(self) -> DataFrame:
        """Scores 0..100 from the line price; null on undiscounted returns."""
        orders = self._read("orders").select("o_orderkey", "o_custkey")
        missing = (F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)
        score = F.floor(F.col("l_extendedprice") / 1050).cast("double")
        return (
            self._read("lineitem")
            .select("l_orderkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_discount")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_custkey").alias("id_student"),
                F.col("l_suppkey").alias("id_assessment"),
                F.when(~missing, score).alias("score"),
            )
        )

    @property
    def event_clicks(self) -> DataFrame:
        """A second clickstream, from the events table."""
        return self._read("events").select(
            "user_id",
            "event_type",
            F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("click_date"),
            F.round(F.col("value") * 100).cast("int").alias("sum_click"),
        )

    @property
    def timed_events(self) -> DataFrame:
        """The events with fractional days since 2024 and their values as weights."""
        micros = F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000
        return self._read("events").select(
            "user_id",
            "event_type",
            (micros / 86_400_000_000).alias("click_date"),
            micros.alias("micros"),
            F.col("value").alias("sum_click"),
        )
