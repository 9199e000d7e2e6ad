"""The seven base tables, their constraints, and the fixed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ENROLMENT_KEYS = ["id_student", "code_module", "code_presentation"]
COURSE_KEYS = ["code_module", "code_presentation"]


def _table(**columns: str | int) -> T.StructType:
    """Schema from ``name=type``; an integer stands for a bounded string.

    Identifiers are 64-bit, a superset of the declared INT that large data need.
    """
    plain = {"int": T.IntegerType(), "id": T.LongType(), "double": T.DoubleType()}
    return T.StructType(
        [
            T.StructField(
                name,
                plain[kind] if isinstance(kind, str) else T.StringType(),
                metadata=None if isinstance(kind, str) else {"max_length": kind},
            )
            for name, kind in columns.items()
        ]
    )


COURSES = _table(code_module=45, code_presentation=45, module_presentation_length="int")

STUDENT_INFO = _table(
    code_module=45,
    code_presentation=45,
    id_student="id",
    gender=3,
    imd_band=16,
    highest_education=45,
    age_band=16,
    number_of_prev_attempts="int",
    studied_credits="int",
    region=45,
    disability=3,
    final_result=45,
)

ASSESSMENTS = _table(
    code_module=45,
    code_presentation=45,
    id_assessment="id",
    assessment_type=45,
    assessment_date="int",
    weight="double",
)

VLE = _table(
    id_site="id",
    code_module=45,
    code_presentation=45,
    activity_type=45,
    week_from="int",
    week_to="int",
)

STUDENT_VLE = _table(
    id_site="id",
    id_student="id",
    code_module=45,
    code_presentation=45,
    click_date="int",
    sum_click="int",
)

STUDENT_ASSESSMENT = _table(
    id_student="id", id_assessment="id", date_submitted="int", score="double"
)

STUDENT_REGISTRATION = _table(
    code_module=45,
    code_presentation=45,
    id_student="id",
    date_registration="int",
    date_unregistration="int",
)

TABLES: dict[str, T.StructType] = {
    "courses": COURSES,
    "studentInfo": STUDENT_INFO,
    "assessments": ASSESSMENTS,
    "vle": VLE,
    "studentVle": STUDENT_VLE,
    "studentAssessment": STUDENT_ASSESSMENT,
    "studentRegistration": STUDENT_REGISTRATION,
}

# Header names met in the published files that differ from the table columns.
HEADER_RENAMES: dict[str, dict[str, str]] = {
    "studentInfo": {"num_of_prev_attempts": "number_of_prev_attempts"},
    "assessments": {"date": "assessment_date"},
    "studentVle": {"date": "click_date", "assessment_date": "click_date"},
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "courses": COURSE_KEYS,
    "studentInfo": ENROLMENT_KEYS,
    "assessments": ["id_assessment"],
    "vle": ["id_site"],
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    parent: str
    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.child}({','.join(self.columns)})->{self.parent}"


# studentAssessment declares a three-column reference to studentInfo but holds
# only the student; module and presentation come from its assessment.
FOREIGN_KEYS: list[ForeignKey] = [
    ForeignKey("studentInfo", "courses", tuple(COURSE_KEYS)),
    ForeignKey("assessments", "courses", tuple(COURSE_KEYS)),
    ForeignKey("vle", "courses", tuple(COURSE_KEYS)),
    ForeignKey("studentVle", "studentInfo", tuple(ENROLMENT_KEYS)),
    ForeignKey("studentVle", "vle", ("id_site",)),
    ForeignKey("studentVle", "courses", tuple(COURSE_KEYS)),
    ForeignKey("studentAssessment", "studentInfo", tuple(ENROLMENT_KEYS)),
    ForeignKey("studentAssessment", "assessments", ("id_assessment",)),
    ForeignKey("studentRegistration", "studentInfo", tuple(ENROLMENT_KEYS)),
    ForeignKey("studentRegistration", "courses", tuple(COURSE_KEYS)),
]


def length_limits(schema: T.StructType) -> dict[str, int]:
    """Column name to maximum length, for the bounded strings of a schema."""
    return {
        f.name: f.metadata["max_length"] for f in schema.fields if "max_length" in (f.metadata or {})
    }


# --- Fixed values: they must equal the published study's for equal results. ---

ACTIVITY_TYPES = [
    "url",
    "forumng",
    "homepage",
    "oucontent",
    "subpage",
    "resource",
    "sharedsubpage",
    "page",
    "questionnaire",
    "ouwiki",
    "htmlactivity",
    "ouelluminate",
    "dataplus",
    "externalquiz",
    "repeatactivity",
    "dualpane",
    "quiz",
    "glossary",
    "oucollaborate",
    "folder",
]

# Module and presentation -> group: February (B) and October (J) runs of a module
# form one group each, over both years.
PRESENTATION_GROUPS: dict[str, int] = {
    "AAA-2013J": 0,
    "AAA-2014J": 0,
    "BBB-2013B": 1,
    "BBB-2014B": 1,
    "BBB-2013J": 2,
    "BBB-2014J": 2,
    "CCC-2014B": 3,
    "CCC-2014J": 4,
    "DDD-2013B": 5,
    "DDD-2014B": 5,
    "DDD-2013J": 6,
    "DDD-2014J": 6,
    "EEE-2013J": 7,
    "EEE-2014J": 7,
    "EEE-2014B": 8,
    "FFF-2013B": 9,
    "FFF-2014B": 9,
    "FFF-2013J": 10,
    "FFF-2014J": 10,
    "GGG-2013J": 11,
    "GGG-2014J": 11,
    "GGG-2014B": 12,
}
GROUPS = list(range(13))
MODEL_GROUPS = list(range(1, 13))

# Every other spelling of a band is unmapped.
DEPRIVATION_DECILES: dict[str, int] = {
    "0-10%": 1,
    "10-20%": 2,
    "20-30%": 3,
    "30-40%": 4,
    "40-50%": 5,
    "50-60%": 6,
    "60-70%": 7,
    "70-80%": 8,
    "80-90%": 9,
    "90-100%": 10,
}

DEGREE_FLAGS: dict[str, int] = {
    "No Formal quals": 0,
    "Lower Than A Level": 0,
    "A Level or Equivalent": 0,
    "HE Qualification": 1,
    "Post Graduate Qualification": 1,
}

DISTINCTION = "Distinction"

CATEGORIES: dict[str, list[str]] = {
    "gender": ["F", "M"],
    "highest_education": [
        "A Level or Equivalent",
        "HE Qualification",
        "Lower Than A Level",
        "No Formal quals",
        "Post Graduate Qualification",
    ],
    "disability": ["N", "Y"],
    "age_band": ["0-35", "35-55", "55<="],
    "region": [
        "East Anglian Region",
        "East Midlands Region",
        "Ireland",
        "London Region",
        "North Region",
        "North Western Region",
        "Scotland",
        "South East Region",
        "South Region",
        "South West Region",
        "Wales",
        "West Midlands Region",
        "Yorkshire Region",
    ],
}

MOMENT_COLUMNS = [
    "click_time_variance",
    "click_time_skewness",
    "click_time_kurtosis",
    "click_time_cv",
]

# --- End of fixed values. ---


def click_column(activity_type: str) -> str:
    return f"total_clicks_{activity_type}"


def dummy_column(source: str, category: str) -> str:
    return f"{source}_{category}"


def modelling_columns() -> list[str]:
    """The modelling frame in order, before its names are cleaned."""
    return [
        "studied_credits",
        *[click_column(t) for t in ACTIVITY_TYPES],
        "pres_groups",
        "dep_dec",
        "distinction",
        *[dummy_column(source, c) for source, values in CATEGORIES.items() for c in values],
        *MOMENT_COLUMNS,
    ]
