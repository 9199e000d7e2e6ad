"""Registered queries over the supplied tables.

Enrolments bound to orders may repeat their key, hence ``unique_info=False``
wherever they are joined before the first attempts are chosen.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpulse.models.evaluate import classification_report, confusion, predicted
from cohortpulse.models.importance import top_gains
from cohortpulse.models.nodes import route_differences, test_rows_kept
from cohortpulse.models.split import exact_test_split, in_test
from cohortpulse.models.train import (
    MAY_BE_MISSING,
    Settings,
    feature_columns,
    fit_study,
    kept_features,
    study_report,
    supports,
)
from cohortpulse.operators import clicks as C
from cohortpulse.operators import cohort as H
from cohortpulse.operators import encode as E
from cohortpulse.operators import moments as M
from cohortpulse.operators import profile as P
from cohortpulse.operators import quality as Q
from cohortpulse.operators import ranking as R
from cohortpulse.operators.incremental import add_increment, engagement_from_state
from cohortpulse.plans.features import described_first_attempts, modelling_table
from cohortpulse.schemas import (
    ACTIVITY_TYPES,
    CATEGORIES,
    ENROLMENT_KEYS,
    MOMENT_COLUMNS,
    STUDENT_INFO,
    click_column,
    dummy_column,
    length_limits,
)
from cohortpulse.session import shared_folder
from cohortpulse.sources.readers import read_base_csv
from cohortpulse.sources.sinks import temporary_folder, temporary_table, write_bucketed, write_features
from cohortpulse.sources.stand_ins import StandIns

NUMBER = "enrolment_no"
ORDER = ("code_presentation", NUMBER)
CLICKS = [click_column(t) for t in ACTIVITY_TYPES]
PROFILED = ["studied_credits", "number_of_prev_attempts", "total_clicks", "avg_score"]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
    """Register a query written over the bound tables under its own name."""
    REGISTRY[fn.__name__] = lambda spark, folder: fn(StandIns(spark, folder))
    return fn


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# --- Scans and shapes ---------------------------------------------------------


@query
def scan_student_info(t: StandIns) -> DataFrame:
    return t.student_info


@query
def scan_student_vle(t: StandIns) -> DataFrame:
    return t.student_vle


@query
def peek_rows(t: StandIns) -> DataFrame:
    return P.peek(t.student_info, [NUMBER], 3)


@query
def table_shapes(t: StandIns) -> DataFrame:
    return (
        P.shape_table(t.student_info, "studentInfo")
        .unionByName(P.shape_table(t.student_vle, "studentVle"))
        .unionByName(P.shape_table(t.vle, "vle"))
    )


@query
def default_columns(t: StandIns) -> DataFrame:
    return C.with_default_columns(t.enrolments.select(NUMBER), ["total_clicks", *CLICKS[:5]])


@query
def csv_load(t: StandIns) -> DataFrame:
    """Enrolments written as CSV with other headers and an extra column, half of them
    in one order of columns and half in another, then loaded into the typed table."""
    path = f"{shared_folder(t.spark)}/csv-{uuid.uuid4().hex}"
    source = t.student_info.select(
        NUMBER,
        F.lit("x").alias("extra"),
        F.col("number_of_prev_attempts").alias("num_of_prev_attempts"),
        *[f.name for f in STUDENT_INFO.fields if f.name != "number_of_prev_attempts"],
    )
    for part, columns in ((0, source.columns[1:]), (1, source.columns[:0:-1])):
        half = source.where(F.col(NUMBER) % 2 == part).select(*columns)
        half.write.option("header", True).option("nullValue", "?").csv(f"{path}/{part}")
    return read_base_csv(t.spark, [f"{path}/0", f"{path}/1"], "studentInfo")


@query
def csv_mixed_headers(t: StandIns) -> DataFrame:
    """The same with three orders of columns in one folder, a third of the rows each. The
    folder stays, as the table is read from it."""
    path = f"{shared_folder(t.spark)}/csv-{uuid.uuid4().hex}"
    names = [f.name for f in STUDENT_INFO.fields]
    source = t.student_info.select(NUMBER, *names, F.lit("x").alias("extra"))
    for part, columns in enumerate((names, names[::-1], ["extra", *names[5:], *names[:5]])):
        third = source.where(F.col(NUMBER) % 3 == part).select(*columns)
        third.write.mode("append").option("header", True).option("nullValue", "?").csv(path)
    return read_base_csv(t.spark, path, "studentInfo")


@query
def feature_sink(t: StandIns) -> DataFrame:
    """Features written by group and read back."""
    wide = C.attach_totals(
        H.with_presentation_group(t.enrolments), C.total_clicks(t.student_vle), unique_info=False
    ).select(NUMBER, "total_clicks", "pres_groups")
    with temporary_folder(t.spark, "sink") as path:
        written = t.spark.read.schema(wide.schema).parquet(write_features(wide, path))
        counted = written.groupBy("pres_groups").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("total_clicks").alias("n_clicks")
        )
        # a row per group, so that the folder can go
        return t.spark.createDataFrame(counted.collect(), counted.schema)


# --- Constraints --------------------------------------------------------------


@query
def pk_violations(t: StandIns) -> DataFrame:
    return Q.key_violations(t.enrolments, ENROLMENT_KEYS)


@query
def fk_orphans(t: StandIns) -> DataFrame:
    """Scores whose student and assessment run match no enrolment."""
    run = t.assessments.select("id_assessment", "code_module", "code_presentation")
    scores = t.student_assessment.join(run, "id_assessment")
    return Q.orphans(scores, t.enrolments, ENROLMENT_KEYS)


@query
def key_checks(t: StandIns) -> DataFrame:
    """All declared primary keys; some assessments have no identifier."""
    known = F.when(F.col("id_assessment") % 50 != 0, F.col("id_assessment"))
    return Q.check_keys(
        {
            "courses": t.courses,
            "studentInfo": t.enrolments,
            "assessments": t.assessments.withColumn("id_assessment", known),
            "vle": t.vle,
        }
    )


@query
def reference_checks(t: StandIns) -> DataFrame:
    """All declared references, with gaps in the tables referred to."""
    return Q.check_references(
        {
            "courses": t.courses.where("code_module <> 'GGG' or code_presentation like '2013%'"),
            "studentInfo": t.enrolments.where(F.col(NUMBER) % 5 != 0),
            "assessments": t.assessments,
            "vle": t.vle_runs.where("id_site % 9 <> 0"),
            "studentVle": t.student_vle,
            "studentAssessment": t.student_assessment,
            "studentRegistration": t.student_registration,
        }
    )


@query
def overlong_strings(t: StandIns) -> DataFrame:
    limits = length_limits(STUDENT_INFO)
    checked = Q.overlong(t.student_info, limits)
    customers = t.spark.read.parquet(f"{t.folder}/customer.parquet")
    return checked.unionByName(Q.overlong(customers, {"c_name": 16, "c_mktsegment": 9}))


@query
def overlong_customers(t: StandIns) -> DataFrame:
    customers = t.spark.read.parquet(f"{t.folder}/customer.parquet")
    return Q.overlong_rows(customers, {"c_name": 45, "c_mktsegment": 9}).select("c_custkey")


# --- Projections --------------------------------------------------------------


@query
def enrol_keys(t: StandIns) -> DataFrame:
    return H.with_enrolment_keys(t.enrolments).select(
        NUMBER, "student_module_pres", "module_pres", "student_and_module"
    )


@query
def presentation_groups(t: StandIns) -> DataFrame:
    return H.with_presentation_group(t.enrolments).select(NUMBER, "pres_groups")


@query
def click_groups(t: StandIns) -> DataFrame:
    return (
        H.with_presentation_group(t.student_vle)
        .groupBy("pres_groups")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sum_click").alias("n_clicks"))
    )


@query
def decile_map(t: StandIns) -> DataFrame:
    return H.with_deprivation_decile(t.student_info).select(NUMBER, "imd_band", "dep_dec")


@query
def degree_flags(t: StandIns) -> DataFrame:
    return H.with_degree_flag(t.student_info).select(NUMBER, "highest_education", "ed_dummy")


@query
def label(t: StandIns) -> DataFrame:
    return H.with_label(t.student_info).select(NUMBER, "final_result", "distinction")


@query
def label_totals(t: StandIns) -> DataFrame:
    return H.label_totals(described_first_attempts(t.student_info, ORDER), group=2)


@query
def first_attempts(t: StandIns) -> DataFrame:
    return H.first_attempts(t.student_info, order_by=ORDER).select(NUMBER, *ENROLMENT_KEYS)


@query
def one_group(t: StandIns) -> DataFrame:
    return H.in_group(H.with_presentation_group(t.enrolments), 3).select(NUMBER, "pres_groups")


@query
def one_hot(t: StandIns) -> DataFrame:
    dummies = [dummy_column(s, v) for s, vs in CATEGORIES.items() for v in vs]
    return E.clean_columns(E.one_hot(t.student_info).select(NUMBER, *[f"`{d}`" for d in dummies]))


@query
def one_hot_observed(t: StandIns) -> DataFrame:
    """Dummies from the categories found in the data."""
    found = E.observed_categories(t.student_info, ["gender", "final_result"])
    names = [dummy_column(s, v) for s, vs in found.items() for v in vs]
    return E.one_hot(t.student_info, found).select(NUMBER, *names)


# --- Clicks -------------------------------------------------------------------


@query
def activity_vocab(t: StandIns) -> DataFrame:
    return C.activity_types(t.vle)


@query
def activity_counts(t: StandIns) -> DataFrame:
    return C.activity_counts(t.student_vle, t.vle)


@query
def click_activity(t: StandIns) -> DataFrame:
    """Clickstream with activity types, summed up per type and day."""
    return (
        C.with_activity_type(t.student_vle, t.vle)
        .groupBy("activity_type", "click_date")
        .agg(F.sum("sum_click").alias("n_clicks"))
    )


@query
def clicks_total(t: StandIns) -> DataFrame:
    info = t.enrolments
    return C.attach_totals(info, C.total_clicks(t.student_vle), unique_info=False)


@query
def clicks_one_type(t: StandIns) -> DataFrame:
    info = t.enrolments
    return C.attach_totals(info, C.clicks_of_type(t.student_vle, t.vle, "forumng"), unique_info=False)


@query
def clicks_by_type_pivot(t: StandIns) -> DataFrame:
    info = t.enrolments
    vocabulary = C.activity_vocabulary(t.vle)
    return C.attach_totals(info, C.clicks_by_type(t.student_vle, t.vle, vocabulary), unique_info=False)


def _many_types(t: StandIns) -> DataFrame:
    """Resources of up to 5000 activity types, one of 50 without any."""
    kind = F.concat(F.lit("type-"), (F.col("id_site") % 5000).cast("string"))
    return t.vle.withColumn("activity_type", F.when(F.col("id_site") % 50 != 7, kind))


@query
def clicks_by_type_sparse(t: StandIns) -> DataFrame:
    """Totals of thousands of activity types, a row per enrolment and type touched."""
    return C.clicks_by_type_long(t.dealt_student_vle, _many_types(t))


@query
def clicks_by_type_maps(t: StandIns) -> DataFrame:
    """The same as one map per enrolment, written out, and two of its entries."""
    maps = C.clicks_by_type_map(C.clicks_by_type_long(t.dealt_student_vle, _many_types(t)))
    entries = F.expr("array_join(transform(map_entries(clicks_by_type), e -> concat(e.key, '=', e.value)), ' ')")
    return maps.select(
        *ENROLMENT_KEYS,
        F.size("clicks_by_type").cast("long").alias("n_types"),
        entries.alias("entries"),
        C.clicks_on("type-11").alias("clicks_11"),
        C.clicks_on("no such type").alias("clicks_none"),
    )


# --- Stored clicks and sums ---------------------------------------------------


def _typed(t: StandIns) -> DataFrame:
    return C.with_activity_type(t.student_vle, t.vle)


@query
def engagement_bucketed(t: StandIns) -> DataFrame:
    """All engagement features of a clickstream that is stored by enrolment. The table
    stays, as the features are read from it; its folder is in the shared one."""
    name = f"clicks_{uuid.uuid4().hex}"
    stored = write_bucketed(_typed(t), name, ENROLMENT_KEYS, 16, f"{shared_folder(t.spark)}/{name}")
    sums = M.engagement_sums(stored, ACTIVITY_TYPES)
    return _rounded(M.finish_engagement(sums, ACTIVITY_TYPES), *MOMENT_COLUMNS)


@query
def engagement_incremental(t: StandIns) -> DataFrame:
    """The same from sums that a base load and two increments, one of them repeated, were
    added to. The state stays, as the features are read from it."""
    path = f"{shared_folder(t.spark)}/state-{uuid.uuid4().hex}"
    typed, day = _typed(t), F.col("click_date")
    for batch, part in ((0, day < 40), (1, day.between(40, 79)), (1, day.between(40, 79)), (2, ~(day < 80))):
        add_increment(path, typed.where(part), batch, ACTIVITY_TYPES, folders=16)
    return _rounded(engagement_from_state(t.spark, path, ACTIVITY_TYPES), *MOMENT_COLUMNS)


# --- Moments ------------------------------------------------------------------


@query
def click_moments(t: StandIns) -> DataFrame:
    return _rounded(M.click_moments(t.student_vle), *MOMENT_COLUMNS)


@query
def moments_events(t: StandIns) -> DataFrame:
    return _rounded(M.click_moments(t.event_clicks, ["user_id"]), *MOMENT_COLUMNS)


@query
def moments_wide_sums(t: StandIns) -> DataFrame:
    """Moments of the events per type, with decimal sums."""
    return _rounded(M.click_moments(t.event_clicks, ["event_type"], wide=True), *MOMENT_COLUMNS)


@query
def moments_fractional(t: StandIns) -> DataFrame:
    """Moments of fractional days with fractional weights, per user."""
    found = _rounded(M.click_moments(t.timed_events, ["user_id"]), "click_time_variance", digits=2)
    return _rounded(found, *MOMENT_COLUMNS[1:])


@query
def moments_microseconds(t: StandIns) -> DataFrame:
    """Moments per type of integers that no exact sum holds."""
    given = t.timed_events.select("event_type", "micros", F.lit(3).alias("sum_click"))
    found = M.click_moments(given, ["event_type"], "micros", floating=True)
    return _rounded(found.withColumn("click_time_variance", F.col("click_time_variance") / 1e18), *MOMENT_COLUMNS, digits=5)


@query
def moments_joined(t: StandIns) -> DataFrame:
    info = t.enrolments
    moments = M.click_moments(t.student_vle)
    return _rounded(M.attach_moments(info, moments, unique_info=False), *MOMENT_COLUMNS)


@query
def engagement_features(t: StandIns) -> DataFrame:
    """Totals, totals per type and moments from one scan of the clickstream."""
    info = t.enrolments
    totals = M.engagement_totals(t.student_vle, t.vle, ACTIVITY_TYPES)
    joined = M.attach_engagement(info, totals, ACTIVITY_TYPES, unique_info=False)
    return _rounded(joined, *MOMENT_COLUMNS)


def _clicks_without_student(t: StandIns) -> DataFrame:
    """Clickstream in which the student is unknown at every fifth resource."""
    return t.student_vle.withColumn("id_student", F.when(F.col("id_site") % 5 != 0, F.col("id_student")))


@query
def totals_null_keys(t: StandIns) -> DataFrame:
    """Totals keep a group whose key is null in part."""
    return C.total_clicks(_clicks_without_student(t))


@query
def moments_null_keys(t: StandIns) -> DataFrame:
    """Moments skip it."""
    return _rounded(M.click_moments(_clicks_without_student(t)), *MOMENT_COLUMNS)


# --- Modelling frame ----------------------------------------------------------


def _modelling(t: StandIns) -> DataFrame:
    return modelling_table(t.student_info, t.student_vle, t.vle, ORDER)


@query
def feature_matrix(t: StandIns) -> DataFrame:
    return _rounded(_modelling(t), *MOMENT_COLUMNS)


@query
def nonzero_columns(t: StandIns) -> DataFrame:
    return E.non_zero_flags(_modelling(t), feature_columns(), "pres_groups")


@query
def missing_indicators(t: StandIns) -> DataFrame:
    filled = E.fill_missing(_modelling(t).select(*ENROLMENT_KEYS, *MAY_BE_MISSING), MAY_BE_MISSING)
    return _rounded(filled, *MOMENT_COLUMNS)


@query
def missing_totals(t: StandIns) -> DataFrame:
    """Click totals that are null, as all their counts are, filled and flagged."""
    clicks = t.student_vle.withColumn("sum_click", F.when(F.col("id_site") % 3 == 0, F.col("sum_click")))
    info = C.attach_totals(t.enrolments, C.total_clicks(clicks), unique_info=False)
    return E.fill_missing(info.select(NUMBER, "total_clicks"), ["total_clicks"])


@query
def model_supports(t: StandIns) -> DataFrame:
    """Training and test rows of every model and class."""
    return supports(described_first_attempts(t.student_info, ORDER))


@query
def model_features(t: StandIns) -> DataFrame:
    """Inputs that every model keeps."""
    return kept_features(_modelling(t))


@query
def hash_split(t: StandIns) -> DataFrame:
    return t.enrolments.select(NUMBER, in_test().cast("int").alias("in_test"))


@query
def exact_split(t: StandIns) -> DataFrame:
    """A test part of exactly a fifth of the enrolments, rounded up."""
    train, test = exact_test_split(t.enrolments.select(NUMBER), [NUMBER])
    return train.withColumn("in_test", F.lit(0)).union(test.withColumn("in_test", F.lit(1)))


@query
def exact_split_tied(t: StandIns) -> DataFrame:
    """The same by students, who are on both sides of the cut at most once."""
    given = t.enrolments.select("id_student")
    train, test = exact_test_split(given, ["id_student"], share=0.33)
    both = train.withColumn("in_test", F.lit(0)).union(test.withColumn("in_test", F.lit(1)))
    return both.groupBy("id_student").agg(F.count(F.lit(1)).alias("n"), F.sum("in_test").alias("n_test"))


# --- Profile and ranking ------------------------------------------------------


def _scored(t: StandIns) -> DataFrame:
    """First attempts with their mean score."""
    first = described_first_attempts(t.student_info, ORDER)
    scores = R.average_scores(t.student_assessment, t.assessments)
    return first.join(scores, ENROLMENT_KEYS, "left")


@query
def profile_numeric(t: StandIns) -> DataFrame:
    """Profile of the enriched enrolments, written once as it is read repeatedly."""
    totals = C.total_clicks(t.student_vle)
    scores = R.average_scores(t.student_assessment, t.assessments)
    info = C.attach_totals(t.student_info, totals, unique_info=False)
    wide = C.left_join_totals(info, scores, ENROLMENT_KEYS, unique_info=False).select(*PROFILED)
    with temporary_table(wide, "profiled") as table:
        profile = P.profile_numeric(table, PROFILED)
    return _rounded(profile, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def average_scores(t: StandIns) -> DataFrame:
    return _rounded(R.average_scores(t.student_assessment, t.assessments), "avg_score")


@query
def top10_with_ties(t: StandIns) -> DataFrame:
    top = R.top_with_ties(_scored(t)).select("pres_groups", NUMBER, "avg_score")
    return _rounded(top, "avg_score")


@query
def degree_share(t: StandIns) -> DataFrame:
    return _rounded(R.degree_share_by_group(_scored(t)), "top_share", "overall_share")


@query
def degree_share_totals(t: StandIns) -> DataFrame:
    scored = _scored(t)
    totals = R.degree_share_totals(scored, R.degree_share_by_group(scored))
    return _rounded(totals, "top_percent", "overall_percent")


# --- Evaluation ---------------------------------------------------------------


def _rule_scored(t: StandIns) -> DataFrame:
    """First attempts with a rule for the probability, which SQL can repeat."""
    first = C.attach_totals(
        described_first_attempts(t.student_info, ORDER), C.total_clicks(t.student_vle)
    )
    clicks = F.col("total_clicks").cast("double")
    return first.withColumn("probability_1", clicks / (clicks + 200.0)).withColumn(
        "prediction", predicted()
    )


@query
def threshold_predict(t: StandIns) -> DataFrame:
    return _rounded(_rule_scored(t).select(NUMBER, "probability_1", "prediction"), "probability_1")


@query
def confusion_matrix(t: StandIns) -> DataFrame:
    return confusion(_rule_scored(t), by=["pres_groups"])


@query
def class_report(t: StandIns) -> DataFrame:
    mapped = _rule_scored(t).where(F.col("pres_groups").isNotNull())
    return _rounded(classification_report(mapped, by=["pres_groups"]), "precision", "recall", "f1")


@query
def one_class_report(t: StandIns) -> DataFrame:
    """Reports of groups of which the first six hold and predict a single class."""
    few = F.col("pres_groups") < 6
    scored = _rule_scored(t).where(F.col("pres_groups").isNotNull())
    single = scored.withColumns({c: F.when(few, 0).otherwise(F.col(c)) for c in ("distinction", "prediction")})
    return _rounded(classification_report(single, by=["pres_groups"]), "precision", "recall", "f1")


# --- Models: no SQL twin. Their results are a few rows per model; they are computed
# here, so that the staged rows and saved models can go. --------------------------


@query
def gbt_group_report(t: StandIns) -> DataFrame:
    """Reports of the twelve group models and the pooled one."""
    with temporary_folder(t.spark, "study") as path:
        report = study_report(fit_study(_modelling(t), path=path))
        return t.spark.createDataFrame(report.collect(), report.schema)


@query
def gbt_gain_top15(t: StandIns) -> DataFrame:
    """The features with the highest gain in each of these models."""
    with temporary_folder(t.spark, "study") as path:
        models = fit_study(_modelling(t), path=f"{path}/rows")
        gains = top_gains(models, path=path)
        return t.spark.createDataFrame(gains.collect(), gains.schema)


@query
def gbt_node_check(t: StandIns) -> DataFrame:
    """Test rows of every model, and those that its saved node table scores otherwise.

    Ten rounds, as the check is of the scoring; counts of rows are those of the full study.
    """
    with temporary_folder(t.spark, "study") as path:
        models = fit_study(_modelling(t), settings=Settings(rounds=10), path=f"{path}/rows")
        with test_rows_kept([m for m in models if m.model is not None]) as kept:
            checks = [route_differences(m, path) for m in kept]
            return t.spark.createDataFrame(reduce(DataFrame.union, checks).collect(), checks[0].schema)
