"""SQL twins of the registered queries, for an independent check.

Common table expressions bind the supplied tables the way
``cohortpulse.sources.stand_ins`` does; each twin then states its result in
plain SQL, with textbook two-step formulas where the library works differently.
"""

from __future__ import annotations

from cohortpulse.schemas import (
    ACTIVITY_TYPES,
    CATEGORIES,
    MOMENT_COLUMNS,
    STUDENT_INFO,
    click_column,
    dummy_column,
    length_limits,
    modelling_columns,
)

KEYS = "id_student, code_module, code_presentation"


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quote(v) for v in values) + "]"


def _clean(name: str) -> str:
    for old, new in ((" ", "_"), ("<=", "+"), (",", "")):
        name = name.replace(old, new)
    return name


def _r6(expression: str, name: str) -> str:
    """Rounded to six places, with no negative zero."""
    return (
        f"CASE WHEN abs({expression}) < 5e-7 THEN 0.0 ELSE round({expression}, 6) END AS {name}"
    )


# Fixed values, stated here once more so that a slip in the library shows.
GROUP_CASE = """CASE
  WHEN code_module = 'AAA' AND code_presentation = '2013J' THEN 0
  WHEN code_module = 'AAA' AND code_presentation = '2014J' THEN 0
  WHEN code_module = 'BBB' AND code_presentation = '2013B' THEN 1
  WHEN code_module = 'BBB' AND code_presentation = '2014B' THEN 1
  WHEN code_module = 'BBB' AND code_presentation = '2013J' THEN 2
  WHEN code_module = 'BBB' AND code_presentation = '2014J' THEN 2
  WHEN code_module = 'CCC' AND code_presentation = '2014B' THEN 3
  WHEN code_module = 'CCC' AND code_presentation = '2014J' THEN 4
  WHEN code_module = 'DDD' AND code_presentation = '2013B' THEN 5
  WHEN code_module = 'DDD' AND code_presentation = '2014B' THEN 5
  WHEN code_module = 'DDD' AND code_presentation = '2013J' THEN 6
  WHEN code_module = 'DDD' AND code_presentation = '2014J' THEN 6
  WHEN code_module = 'EEE' AND code_presentation = '2013J' THEN 7
  WHEN code_module = 'EEE' AND code_presentation = '2014J' THEN 7
  WHEN code_module = 'EEE' AND code_presentation = '2014B' THEN 8
  WHEN code_module = 'FFF' AND code_presentation = '2013B' THEN 9
  WHEN code_module = 'FFF' AND code_presentation = '2014B' THEN 9
  WHEN code_module = 'FFF' AND code_presentation = '2013J' THEN 10
  WHEN code_module = 'FFF' AND code_presentation = '2014J' THEN 10
  WHEN code_module = 'GGG' AND code_presentation = '2013J' THEN 11
  WHEN code_module = 'GGG' AND code_presentation = '2014J' THEN 11
  WHEN code_module = 'GGG' AND code_presentation = '2014B' THEN 12
  END"""
DECILE_CASE = """CASE imd_band
  WHEN '0-10%' THEN 1
  WHEN '10-20%' THEN 2
  WHEN '20-30%' THEN 3
  WHEN '30-40%' THEN 4
  WHEN '40-50%' THEN 5
  WHEN '50-60%' THEN 6
  WHEN '60-70%' THEN 7
  WHEN '70-80%' THEN 8
  WHEN '80-90%' THEN 9
  WHEN '90-100%' THEN 10
  END"""
DEGREE_CASE = """CASE highest_education
  WHEN 'No Formal quals' THEN 0
  WHEN 'Lower Than A Level' THEN 0
  WHEN 'A Level or Equivalent' THEN 0
  WHEN 'HE Qualification' THEN 1
  WHEN 'Post Graduate Qualification' THEN 1
  END"""
LABEL_CASE = "CASE WHEN final_result = 'Distinction' THEN 1 ELSE 0 END"

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

CTES = {
    "runs": """
        SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_custkey AS id_student,
               repeat(chr(65 + CAST(dayofweek(o_orderdate) AS INTEGER)), 3) AS code_module,
               (CASE WHEN year(o_orderdate) % 2 = 1 THEN '2013' ELSE '2014' END)
                 || (CASE WHEN month(o_orderdate) <= 6 THEN 'B' ELSE 'J' END) AS code_presentation
        FROM orders""",
    "info": f"""
        SELECT o_orderkey AS enrolment_no, code_module, code_presentation, id_student,
               CASE WHEN c_nationkey = 24 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               CASE WHEN c_acctbal < 0 THEN '10-20'
                    ELSE (CAST(floor(c_acctbal / 1000) AS BIGINT) * 10) || '-'
                      || (CAST(floor(c_acctbal / 1000) AS BIGINT) * 10 + 10) || '%' END AS imd_band,
               ({_list(CATEGORIES["highest_education"])})[list_position({_list(SEGMENTS)}, c_mktsegment)]
                 AS highest_education,
               ({_list(CATEGORIES["age_band"])})[c_nationkey // 10 + 1] AS age_band,
               CASE WHEN month(o_orderdate) IN (5, 6, 11, 12) THEN 1 ELSE 0 END AS number_of_prev_attempts,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 30 AS studied_credits,
               ({_list(CATEGORIES["region"])})[c_nationkey % 13 + 1] AS region,
               CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'N' END AS disability,
               CASE o_orderstatus WHEN 'F' THEN 'Distinction' WHEN 'O' THEN 'Pass' END AS final_result
        FROM runs JOIN customer ON id_student = c_custkey""",
    "resources": f"""
        SELECT p_partkey AS id_site,
               CASE WHEN p_size < 50 THEN ({_list(ACTIVITY_TYPES)})[p_size % 20 + 1] END AS activity_type
        FROM part""",
    "clicks": """
        SELECT l_partkey AS id_site, id_student, code_module, code_presentation,
               CAST(datediff('day', o_orderdate, l_shipdate) AS INTEGER) AS click_date,
               CAST(l_quantity AS INTEGER) AS sum_click
        FROM lineitem JOIN runs ON l_orderkey = o_orderkey""",
    "typed": """
        SELECT c.*, r.activity_type FROM clicks c LEFT JOIN resources r USING (id_site)""",
    "assess": """
        SELECT s_suppkey AS id_assessment,
               repeat(chr(65 + CAST(s_suppkey % 7 AS INTEGER)), 3) AS code_module,
               (CASE WHEN (s_suppkey // 7) % 4 < 2 THEN '2013' ELSE '2014' END)
                 || (CASE WHEN (s_suppkey // 7) % 2 = 0 THEN 'B' ELSE 'J' END) AS code_presentation
        FROM supplier""",
    "scores": """
        SELECT o_custkey AS id_student, l_suppkey AS id_assessment,
               CASE WHEN NOT (l_returnflag = 'R' AND l_discount = 0)
                    THEN CAST(floor(l_extendedprice / 1050) AS DOUBLE) END AS score
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "mean_scores": f"""
        SELECT {KEYS}, CAST(sum(score) AS DOUBLE) / nullif(count(score), 0) AS avg_score
        FROM scores JOIN assess USING (id_assessment) GROUP BY {KEYS}""",
    "user_clicks": """
        SELECT user_id, event_type, CAST(datediff('day', DATE '2024-01-01', ts) AS INTEGER) AS click_date,
               CAST(round(value * 100) AS INTEGER) AS sum_click
        FROM events""",
    "totals": f"""
        SELECT {KEYS}, 1 AS matched, CAST(sum(sum_click) AS BIGINT) AS total_clicks
        FROM clicks GROUP BY {KEYS}""",
    "type_totals": f"""
        SELECT {KEYS}, 1 AS matched, """
    + ", ".join(
        f"CASE WHEN count(*) FILTER (activity_type = '{t}') = 0 THEN 0 "
        f"ELSE CAST(sum(sum_click) FILTER (activity_type = '{t}') AS BIGINT) END AS {click_column(t)}"
        for t in ACTIVITY_TYPES
    )
    + f" FROM typed GROUP BY {KEYS}",
    "first": f"""
        SELECT *, {GROUP_CASE} AS pres_groups, {DECILE_CASE} AS dep_dec, {DEGREE_CASE} AS ed_dummy,
               {LABEL_CASE} AS distinction
        FROM (SELECT *, row_number() OVER (PARTITION BY id_student, code_module
                                           ORDER BY code_presentation, enrolment_no) AS rn FROM info)
        WHERE rn = 1 AND number_of_prev_attempts = 0""",
    "scored": f"""
        SELECT f.*, s.avg_score FROM first f LEFT JOIN mean_scores s USING ({KEYS})""",
    "ranked": """
        SELECT *, rank() OVER (PARTITION BY pres_groups ORDER BY avg_score DESC) AS place
        FROM scored WHERE pres_groups IS NOT NULL AND avg_score IS NOT NULL""",
    "shares": """
        SELECT a.pres_groups, t.top_share, a.overall_share
        FROM (SELECT pres_groups, avg(ed_dummy) AS overall_share FROM scored
              WHERE pres_groups IS NOT NULL GROUP BY pres_groups) a
        LEFT JOIN (SELECT pres_groups, avg(ed_dummy) AS top_share FROM ranked
                   WHERE place <= 10 GROUP BY pres_groups) t USING (pres_groups)""",
    "ruled": f"""
        SELECT *, CASE WHEN probability_1 >= 0.3 THEN 1 ELSE 0 END AS prediction FROM (
          SELECT f.*, (CASE WHEN t.matched = 1 THEN t.total_clicks ELSE 0 END)::DOUBLE
                 / ((CASE WHEN t.matched = 1 THEN t.total_clicks ELSE 0 END)::DOUBLE + 200.0) AS probability_1
          FROM first f LEFT JOIN totals t USING ({KEYS}))""",
}


def _moment_ctes(source: str, keys: str) -> dict[str, str]:
    """Moments by their definition: weighted mean first, then weighted deviations.

    The variance takes integer sums, W S2 - S1**2 over W**2: its values are large
    enough for the last digit of a double to show after rounding.
    """
    return {
        "means": f"""
            SELECT {keys}, sum(sum_click)::HUGEINT AS w, sum(sum_click::HUGEINT * click_date)::HUGEINT AS s1,
                   sum(sum_click::HUGEINT * click_date * click_date)::HUGEINT AS s2,
                   sum(sum_click::HUGEINT * click_date)::DOUBLE / nullif(sum(sum_click), 0) AS mu
            FROM {source} GROUP BY {keys}""",
        "deviations": f"""
            SELECT {keys}, any_value(mu) AS mu, any_value(w)::DOUBLE AS w,
                   any_value(w * s2 - s1 * s1)::DOUBLE AS spread,
                   sum(sum_click * pow(click_date - mu, 3)) AS d3, sum(sum_click * pow(click_date - mu, 4)) AS d4
            FROM {source} JOIN means USING ({keys}) GROUP BY {keys}""",
        "moments": f"""
            SELECT {keys}, v AS click_time_variance,
                   d3 / w / pow(nullif(v, 0), 1.5) AS click_time_skewness,
                   d4 / w / (nullif(v, 0) * v) - 3 AS click_time_kurtosis,
                   sqrt(nullif(v, 0)) / nullif(mu, 0) AS click_time_cv
            FROM (SELECT *, spread / nullif(w * w, 0) AS v FROM deviations)""",
    }


def _float_moments(source: str, keys: str) -> dict[str, str]:
    """The same definition in doubles, for fractional days and weights."""
    return {
        "means": f"SELECT {keys}, sum(w) AS w, sum(w * d) / nullif(sum(w), 0) AS mu FROM {source} GROUP BY {keys}",
        "deviations": f"""
            SELECT {keys}, any_value(mu) AS mu, any_value(m.w) AS w, sum(s.w * pow(d - mu, 2)) AS d2,
                   sum(s.w * pow(d - mu, 3)) AS d3, sum(s.w * pow(d - mu, 4)) AS d4
            FROM {source} s JOIN means m USING ({keys}) GROUP BY {keys}""",
        "moments": f"""
            SELECT {keys}, d2 / w AS click_time_variance, d3 / w / pow(nullif(d2 / w, 0), 1.5) AS click_time_skewness,
                   d4 / w / pow(nullif(d2 / w, 0), 2) - 3 AS click_time_kurtosis, sqrt(d2 / w) / nullif(mu, 0) AS click_time_cv
            FROM (SELECT * REPLACE (nullif(w, 0) AS w) FROM deviations)""",
    }


MANY_TYPES = "SELECT *, 'type-' || (id_site % 5000) AS activity_type FROM clicks WHERE id_site % 50 <> 7"


def _order_hash(column: str) -> str:
    return f"CAST('0x' || substr(md5('1|' || {column}), 1, 15) AS BIGINT)"


MICROS = "(epoch_us(ts) - 1704067200000000)"
ROUNDED_MOMENTS = ", ".join(_r6(m, m) for m in MOMENT_COLUMNS)

# What each expression reads, so that a twin carries only what it needs.
NEEDS = {
    "info": ["runs"],
    "clicks": ["runs"],
    "typed": ["clicks", "resources"],
    "mean_scores": ["scores", "assess"],
    "totals": ["clicks"],
    "type_totals": ["typed"],
    "first": ["info"],
    "scored": ["first", "mean_scores"],
    "ranked": ["scored"],
    "shares": ["ranked"],
    "ruled": ["first", "totals"],
}


def _with(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered]
    parts += [f"{n} AS ({text})" for n, text in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _zero(column: str, table: str) -> str:
    return f"CASE WHEN {table}.matched = 1 THEN {table}.{column} ELSE 0 END AS {column}"


def _dummy(source: str, value: str, table: str = "") -> str:
    return f"CASE WHEN {table}{source} = {_quote(value)} THEN 1 ELSE 0 END"


DUMMIES = {
    dummy_column(s, v): (s, v) for s, values in CATEGORIES.items() for v in values
}
PIVOT = ", ".join(_zero(click_column(t), "y") for t in ACTIVITY_TYPES)
MOMENTS = _moment_ctes("clicks", KEYS)


def _feature_columns() -> list[tuple[str, str]]:
    """Expression and cleaned name of every modelling column."""
    out = []
    for name in modelling_columns():
        if name in DUMMIES:
            expression = _dummy(*DUMMIES[name], "f.")
        elif name.startswith("total_clicks_"):
            expression = f"CASE WHEN y.matched = 1 THEN y.{name} ELSE 0 END"
        elif name in MOMENT_COLUMNS:
            expression = f"m.{name}"
        else:
            expression = f"f.{name}"
        out.append((expression, _clean(name)))
    return out


def _matrix(rounded: bool) -> str:
    columns = ", ".join(
        _r6(e, n) if rounded and n in MOMENT_COLUMNS else f'{e} AS "{n}"' for e, n in _feature_columns()
    )
    keys = ", ".join(f"f.{k}" for k in KEYS.split(", "))
    return (
        f"SELECT {keys}, {columns} FROM first f LEFT JOIN type_totals y USING ({KEYS}) "
        f"LEFT JOIN moments m USING ({KEYS})"
    )


INPUTS = [n for _, n in _feature_columns() if n not in ("distinction", "pres_groups")]


def _missing(name: str, rounded: bool) -> str:
    filled = f"coalesce({name}, 0.0)::DOUBLE"
    value = _r6(filled, name) if rounded else f"{filled} AS {name}"
    return f"{value}, CASE WHEN {name} IS NULL THEN 1 ELSE 0 END AS {name}_missing"


def _length_row(table: str, column: str, limit: int) -> str:
    return (
        f"SELECT '{column}' AS column_name, {limit} AS max_allowed, "
        f"count(*) FILTER (length({column}) > {limit}) AS n_overlong, max(length({column})) AS longest FROM {table}"
    )


def _profile_row(column: str) -> str:
    quartiles = ", ".join(
        f"round(quantile_cont({column}::DOUBLE, {p}), 6) AS p{int(100 * p)}" for p in (0.25, 0.5, 0.75)
    )
    return (
        f"SELECT '{column}' AS column_name, count({column}) AS count, round(avg({column}), 6) AS mean, "
        f"round(stddev_samp({column}), 6) AS std, round(min({column})::DOUBLE, 6) AS min, {quartiles}, "
        f"round(max({column})::DOUBLE, 6) AS max FROM wide"
    )


REPORT = """
SELECT pres_groups, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM (
  SELECT pres_groups, class, p AS precision, r AS recall, f AS f1, support FROM classes
  UNION ALL
  SELECT pres_groups, 'accuracy', a, a, a, n
  FROM (SELECT pres_groups, count(*) AS n, avg(CASE WHEN distinction = prediction THEN 1.0 ELSE 0.0 END) AS a
        FROM ruled WHERE pres_groups IS NOT NULL GROUP BY pres_groups)
  UNION ALL
  SELECT pres_groups, 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM classes GROUP BY pres_groups
  UNION ALL
  SELECT pres_groups, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
         sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM classes GROUP BY pres_groups
)"""
CLASSES = """
SELECT pres_groups, class, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f, support
FROM (
  SELECT pres_groups, CAST(k AS VARCHAR) AS class,
         CASE WHEN count(*) FILTER (prediction = k) = 0 THEN 0.0
              ELSE count(*) FILTER (prediction = k AND distinction = k)::DOUBLE
                   / count(*) FILTER (prediction = k) END AS p,
         CASE WHEN count(*) FILTER (distinction = k) = 0 THEN 0.0
              ELSE count(*) FILTER (prediction = k AND distinction = k)::DOUBLE
                   / count(*) FILTER (distinction = k) END AS r,
         count(*) FILTER (distinction = k) AS support
  FROM ruled, (VALUES (0), (1)) v(k) WHERE pres_groups IS NOT NULL GROUP BY pres_groups, k
  HAVING count(*) FILTER (prediction = k OR distinction = k) > 0
)"""


def _reference(name: str, child: str, parent: str, columns: str) -> str:
    names = columns.split(", ")
    same = " AND ".join(f"p.{c} = c.{c}" for c in names)
    there = " AND ".join(f"c.{c} IS NOT NULL" for c in names)
    key = " || '-' || ".join(f"c.{c}" for c in names)
    return (
        f"SELECT '{name}' AS reference, CAST({key} AS VARCHAR) AS key, count(*) AS n_rows FROM {child} c "
        f"WHERE {there} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {same}) GROUP BY ALL"
    )


REFERENCE_TABLES = {
    "p_courses": "SELECT DISTINCT code_module, code_presentation FROM runs "
    "WHERE code_module <> 'GGG' OR code_presentation LIKE '2013%'",
    "p_info": "SELECT * FROM runs WHERE o_orderkey % 5 <> 0",
    "p_vle": """
        SELECT p_partkey AS id_site, repeat(chr(65 + CAST(p_partkey % 8 AS INTEGER)), 3) AS code_module,
               (CASE WHEN p_partkey % 2 = 0 THEN '2013' ELSE '2014' END)
                 || (CASE WHEN (p_partkey // 8) % 2 = 0 THEN 'B' ELSE 'J' END) AS code_presentation
        FROM part WHERE p_partkey % 9 <> 0""",
    "placed_scores": "SELECT * FROM scores JOIN assess USING (id_assessment)",
    "registered": """
        SELECT id_student, code_module,
               CASE WHEN o_orderstatus = 'P' THEN NULL WHEN year(o_orderdate) = 1998 THEN '2015B'
                    ELSE code_presentation END AS code_presentation
        FROM runs""",
}
RUN = "code_module, code_presentation"
REFERENCES = " UNION ALL ".join(
    _reference(*row)
    for row in (
        ("studentInfo(code_module,code_presentation)->courses", "p_info", "p_courses", RUN),
        ("assessments(code_module,code_presentation)->courses", "assess", "p_courses", RUN),
        ("vle(code_module,code_presentation)->courses", "p_vle", "p_courses", RUN),
        ("studentVle(id_student,code_module,code_presentation)->studentInfo", "clicks", "p_info", KEYS),
        ("studentVle(id_site)->vle", "clicks", "p_vle", "id_site"),
        ("studentVle(code_module,code_presentation)->courses", "clicks", "p_courses", RUN),
        ("studentAssessment(id_student,code_module,code_presentation)->studentInfo", "placed_scores", "p_info", KEYS),
        ("studentAssessment(id_assessment)->assessments", "scores", "assess", "id_assessment"),
        ("studentRegistration(id_student,code_module,code_presentation)->studentInfo", "registered", "p_info", KEYS),
        ("studentRegistration(code_module,code_presentation)->courses", "registered", "p_courses", RUN),
    )
)


def build() -> dict[str, str]:
    info_columns = ", ".join(f.name for f in STUDENT_INFO.fields)
    shapes = " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, count(*) AS n_rows, CAST({len(cols)} AS BIGINT) AS n_columns, "
        f"'{','.join(cols)}' AS columns FROM {cte}"
        for label, cte, cols in (
            ("studentInfo", "info", ["enrolment_no", "code_module", "code_presentation", "id_student",
                                     *[f.name for f in STUDENT_INFO.fields[3:]]]),
            ("studentVle", "clicks", ["id_site", "id_student", "code_module", "code_presentation",
                                      "click_date", "sum_click"]),
            ("vle", "resources", ["id_site", "activity_type"]),
        )
    )
    lengths = [_length_row("info", c, n) for c, n in length_limits(STUDENT_INFO).items()]
    lengths += [_length_row("customer", "c_name", 16), _length_row("customer", "c_mktsegment", 9)]
    matrix = {**MOMENTS, "matrix": _matrix(False)}
    kept = ", ".join(f'max(CASE WHEN "{n}" IS NULL OR "{n}" <> 0 THEN 1 ELSE 0 END) AS "{n}"' for n in INPUTS)
    split = (
        "CASE WHEN CAST('0x' || substr(md5('1-' || id_student || '-' || code_module || '-' || code_presentation), "
        "1, 8) AS BIGINT) % 100 < 20 THEN 1 ELSE 0 END"
    )
    engagement = _with(
        ["clicks", "totals", "type_totals"],
        f"SELECT {KEYS}, t.total_clicks, {PIVOT}, {ROUNDED_MOMENTS} FROM totals t "
        f"LEFT JOIN type_totals y USING ({KEYS}) LEFT JOIN moments m USING ({KEYS})",
        MOMENTS,
    )
    profiled = ["studied_credits", "number_of_prev_attempts", "total_clicks", "avg_score"]
    wide = {
        "wide": f"SELECT i.*, {_zero('total_clicks', 't')}, s.avg_score FROM info i "
        f"LEFT JOIN totals t USING ({KEYS}) LEFT JOIN mean_scores s USING ({KEYS})"
    }
    numbered = f"i.enrolment_no, {', '.join('i.' + k for k in KEYS.split(', '))}"
    return {
        "scan_student_info": _with(["info"], "SELECT * FROM info"),
        "scan_student_vle": _with(["clicks"], "SELECT * FROM clicks"),
        "peek_rows": _with(["info"], "SELECT * FROM info ORDER BY enrolment_no LIMIT 3"),
        "table_shapes": _with(["info", "clicks", "resources"], shapes),
        "default_columns": "SELECT o_orderkey AS enrolment_no, 0 AS total_clicks, "
        + ", ".join(f"0 AS {click_column(t)}" for t in ACTIVITY_TYPES[:5])
        + " FROM orders",
        "csv_load": _with(["info"], f"SELECT {info_columns} FROM info"),
        "csv_mixed_headers": _with(["info"], f"SELECT {info_columns} FROM info"),
        "feature_sink": _with(
            ["info", "totals"],
            f"SELECT pres_groups, count(*) AS n_rows, CAST(sum(total_clicks) AS BIGINT) AS n_clicks FROM ("
            f"SELECT {GROUP_CASE} AS pres_groups, {_zero('total_clicks', 't')} FROM info i "
            f"LEFT JOIN totals t USING ({KEYS})) GROUP BY pres_groups",
        ),
        "pk_violations": _with(
            ["info"],
            f"SELECT {KEYS}, count(*) AS n_rows, 'duplicate key' AS problem FROM info "
            f"GROUP BY {KEYS} HAVING count(*) > 1",
        ),
        "fk_orphans": _with(
            ["info", "scores", "assess"],
            f"SELECT {KEYS}, count(*) AS n_rows FROM scores JOIN assess USING (id_assessment) "
            f"WHERE ({KEYS}) NOT IN (SELECT ({KEYS}) FROM info) GROUP BY {KEYS}",
        ),
        "key_checks": _with(
            ["info", "assess"],
            "SELECT 'studentInfo' AS table_name, id_student || '-' || code_module || '-' || code_presentation AS key, "
            f"count(*) AS n_rows, 'duplicate key' AS problem FROM info GROUP BY {KEYS} HAVING count(*) > 1 "
            "UNION ALL SELECT 'assessments', 'NULL', count(*), 'null key' FROM assess WHERE id_assessment % 50 = 0 "
            "HAVING count(*) > 0",
        ),
        "reference_checks": _with(["runs", "clicks", "scores", "assess"], REFERENCES, REFERENCE_TABLES),
        "overlong_strings": _with(["info"], " UNION ALL ".join(lengths)),
        "overlong_customers": "SELECT c_custkey FROM customer WHERE length(c_name) > 45 OR length(c_mktsegment) > 9",
        "enrol_keys": _with(
            ["info"],
            "SELECT enrolment_no, id_student || '-' || code_module || '-' || code_presentation AS student_module_pres, "
            "code_module || '-' || code_presentation AS module_pres, "
            "id_student || code_module AS student_and_module FROM info",
        ),
        "presentation_groups": _with(["info"], f"SELECT enrolment_no, {GROUP_CASE} AS pres_groups FROM info"),
        "click_groups": _with(
            ["clicks"],
            f"SELECT {GROUP_CASE} AS pres_groups, count(*) AS n_rows, CAST(sum(sum_click) AS BIGINT) AS n_clicks "
            "FROM clicks GROUP BY 1",
        ),
        "decile_map": _with(["info"], f"SELECT enrolment_no, imd_band, {DECILE_CASE} AS dep_dec FROM info"),
        "degree_flags": _with(
            ["info"], f"SELECT enrolment_no, highest_education, {DEGREE_CASE} AS ed_dummy FROM info"
        ),
        "label": _with(["info"], f"SELECT enrolment_no, final_result, {LABEL_CASE} AS distinction FROM info"),
        "label_totals": _with(
            ["first"],
            "SELECT CAST(sum(distinction) AS BIGINT) AS n_distinctions, "
            "count(*) FILTER (pres_groups = 2) AS n_in_group FROM first",
        ),
        "first_attempts": _with(["first"], f"SELECT enrolment_no, {KEYS} FROM first"),
        "one_group": _with(
            ["info"],
            f"SELECT enrolment_no, {GROUP_CASE} AS pres_groups FROM info WHERE {GROUP_CASE} = 3",
        ),
        "one_hot": _with(
            ["info"],
            "SELECT enrolment_no, "
            + ", ".join(f'{_dummy(*sv)} AS "{_clean(n)}"' for n, sv in DUMMIES.items())
            + " FROM info",
        ),
        "one_hot_observed": _with(
            ["info"],
            "SELECT enrolment_no, "
            + ", ".join(
                f"{_dummy(s, v)} AS {s}_{v}"
                for s, v in (("gender", "F"), ("gender", "M"), ("final_result", "Distinction"), ("final_result", "Pass"))
            )
            + " FROM info",
        ),
        "activity_vocab": _with(
            ["resources"], "SELECT DISTINCT activity_type FROM resources WHERE activity_type IS NOT NULL"
        ),
        "activity_counts": _with(
            ["typed"],
            "SELECT activity_type, count(*) AS n_rows, CAST(sum(sum_click) AS BIGINT) AS n_clicks "
            "FROM typed GROUP BY activity_type",
        ),
        "click_activity": _with(
            ["typed"],
            "SELECT activity_type, click_date, CAST(sum(sum_click) AS BIGINT) AS n_clicks "
            "FROM typed GROUP BY activity_type, click_date",
        ),
        "clicks_total": _with(
            ["info", "totals"],
            f"SELECT {numbered}, {_zero('total_clicks', 't')} FROM info i LEFT JOIN totals t USING ({KEYS})",
        ),
        "clicks_one_type": _with(
            ["info", "typed"],
            f"SELECT {numbered}, CASE WHEN t.matched = 1 THEN t.n ELSE 0 END AS total_clicks_forumng FROM info i "
            f"LEFT JOIN (SELECT {KEYS}, 1 AS matched, CAST(sum(sum_click) AS BIGINT) AS n FROM typed "
            f"WHERE activity_type = 'forumng' GROUP BY {KEYS}) t USING ({KEYS})",
        ),
        "clicks_by_type_pivot": _with(
            ["info", "type_totals"],
            f"SELECT {numbered}, {PIVOT} FROM info i LEFT JOIN type_totals y USING ({KEYS})",
        ),
        "clicks_by_type_sparse": _with(
            ["clicks"],
            f"SELECT {KEYS}, activity_type, CAST(sum(sum_click) AS BIGINT) AS total_clicks FROM kinds GROUP BY ALL",
            {"kinds": MANY_TYPES},
        ),
        "clicks_by_type_maps": _with(
            ["clicks"],
            f"SELECT {KEYS}, count(*) AS n_types, string_agg(activity_type || '=' || n, ' ' ORDER BY activity_type) AS entries, "
            "CAST(coalesce(sum(n) FILTER (activity_type = 'type-11'), 0) AS BIGINT) AS clicks_11, CAST(0 AS BIGINT) AS clicks_none "
            f"FROM (SELECT {KEYS}, activity_type, CAST(sum(sum_click) AS BIGINT) AS n FROM kinds GROUP BY ALL) GROUP BY {KEYS}",
            {"kinds": MANY_TYPES},
        ),
        "engagement_bucketed": engagement,
        "engagement_incremental": engagement,
        "click_moments": _with(["clicks"], f"SELECT {KEYS}, {ROUNDED_MOMENTS} FROM moments", MOMENTS),
        "totals_null_keys": _with(
            ["clicks"],
            "SELECT CASE WHEN id_site % 5 <> 0 THEN id_student END AS id_student, code_module, code_presentation, "
            "CAST(sum(sum_click) AS BIGINT) AS total_clicks FROM clicks GROUP BY 1, 2, 3",
        ),
        "moments_null_keys": _with(
            ["clicks"],
            f"SELECT {KEYS}, {ROUNDED_MOMENTS} FROM moments",
            {"named": "SELECT * FROM clicks WHERE id_site % 5 <> 0", **_moment_ctes("named", KEYS)},
        ),
        "moments_events": _with(
            ["user_clicks"],
            f"SELECT user_id, {ROUNDED_MOMENTS} FROM moments",
            _moment_ctes("user_clicks", "user_id"),
        ),
        "moments_wide_sums": _with(
            ["user_clicks"],
            f"SELECT event_type, {ROUNDED_MOMENTS} FROM moments",
            _moment_ctes("user_clicks", "event_type"),
        ),
        "moments_fractional": _with(
            [],
            "SELECT user_id, round(click_time_variance, 2) AS click_time_variance, "
            + ", ".join(_r6(m, m) for m in MOMENT_COLUMNS[1:])
            + " FROM moments",
            {"timed": f"SELECT user_id, {MICROS} / 86400000000 AS d, value AS w FROM events", **_float_moments("timed", "user_id")},
        ),
        "moments_microseconds": _with(
            [],
            "SELECT event_type, round(click_time_variance / 1e18, 5) AS click_time_variance, "
            + ", ".join(f"round({m}, 5) AS {m}" for m in MOMENT_COLUMNS[1:])
            + " FROM moments",
            {"timed": f"SELECT event_type, {MICROS}::DOUBLE AS d, 3.0::DOUBLE AS w FROM events", **_float_moments("timed", "event_type")},
        ),
        "moments_joined": _with(
            ["info", "clicks"],
            f"SELECT {numbered}, {ROUNDED_MOMENTS} FROM info i LEFT JOIN moments m USING ({KEYS})",
            MOMENTS,
        ),
        "engagement_features": _with(
            ["info", "totals", "type_totals"],
            f"SELECT {numbered}, {_zero('total_clicks', 't')}, {PIVOT}, {ROUNDED_MOMENTS} FROM info i "
            f"LEFT JOIN totals t USING ({KEYS}) LEFT JOIN type_totals y USING ({KEYS}) "
            f"LEFT JOIN moments m USING ({KEYS})",
            MOMENTS,
        ),
        "feature_matrix": _with(["first", "type_totals"], _matrix(True), MOMENTS),
        "nonzero_columns": _with(
            ["first", "type_totals"], f"SELECT pres_groups, {kept} FROM matrix GROUP BY pres_groups", matrix
        ),
        "missing_indicators": _with(
            ["first", "clicks"],
            f"SELECT f.id_student, f.code_module, f.code_presentation, {_missing('dep_dec', False)}, "
            + ", ".join(_missing(m, True) for m in MOMENT_COLUMNS)
            + f" FROM first f LEFT JOIN moments m USING ({KEYS})",
            MOMENTS,
        ),
        "missing_totals": _with(
            ["info", "clicks"],
            "SELECT enrolment_no, coalesce(n, 0)::DOUBLE AS total_clicks, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS "
            "total_clicks_missing FROM (SELECT i.enrolment_no, CASE WHEN t.matched = 1 THEN t.n ELSE 0 END AS n "
            f"FROM info i LEFT JOIN (SELECT {KEYS}, 1 AS matched, sum(sum_click) FILTER (id_site % 3 = 0) AS n "
            f"FROM clicks GROUP BY {KEYS}) t USING ({KEYS}))",
        ),
        "model_supports": _with(
            ["first"],
            "SELECT model, distinction AS class, count(*) FILTER (t = 0) AS n_train, count(*) FILTER (t = 1) AS n_test "
            f"FROM (SELECT 'all' AS model, distinction, {split} AS t FROM first UNION ALL "
            f"SELECT CAST(pres_groups AS VARCHAR), distinction, {split} FROM first WHERE pres_groups BETWEEN 1 AND 12) "
            "GROUP BY model, distinction",
        ),
        "gbt_node_check": _with(
            ["first"],
            "SELECT model, CAST(sum(n_test) AS BIGINT) AS n_rows, CAST(sum(n_test) AS BIGINT) AS n_by_nodes, "
            "CAST(0 AS BIGINT) AS n_far, CAST(0 AS BIGINT) AS n_decided_otherwise FROM ("
            "SELECT model, distinction, count(*) FILTER (t = 0) AS n_train, count(*) FILTER (t = 1) AS n_test "
            f"FROM (SELECT 'all' AS model, distinction, {split} AS t FROM first UNION ALL "
            f"SELECT CAST(pres_groups AS VARCHAR), distinction, {split} FROM first WHERE pres_groups BETWEEN 1 AND 12) "
            "GROUP BY model, distinction) GROUP BY model HAVING count(*) FILTER (n_train > 0) = 2",
        ),
        "model_features": _with(
            ["first", "type_totals"],
            "SELECT CAST(pres_groups AS VARCHAR) AS model, feature FROM (UNPIVOT flags ON COLUMNS(* EXCLUDE (pres_groups)) "
            "INTO NAME feature VALUE used) WHERE used = 1 UNION ALL SELECT 'all', unnest("
            + _list(INPUTS)
            + ")",
            {**matrix, "flags": f"SELECT pres_groups, {kept} FROM matrix WHERE pres_groups BETWEEN 1 AND 12 GROUP BY pres_groups"},
        ),
        "exact_split": _with(
            ["runs"],
            f"SELECT o_orderkey AS enrolment_no, CAST(row_number() OVER (ORDER BY {_order_hash('o_orderkey')}) "
            "<= ceil(count(*) OVER () / 5) AS INTEGER) AS in_test FROM runs",
        ),
        "exact_split_tied": _with(
            ["runs"],
            "SELECT id_student, count(*) AS n, CAST(sum(CAST(place <= cut AS INTEGER)) AS BIGINT) AS n_test FROM ("
            f"SELECT id_student, row_number() OVER (ORDER BY {_order_hash('id_student')}) AS place, "
            "(count(*) OVER () * 33 + 99) // 100 AS cut FROM runs) GROUP BY id_student",
        ),
        "hash_split": _with(["info"], f"SELECT enrolment_no, {split} AS in_test FROM info"),
        "profile_numeric": _with(
            ["info", "totals", "mean_scores"], " UNION ALL ".join(_profile_row(c) for c in profiled), wide
        ),
        "average_scores": _with(
            ["mean_scores"], f"SELECT {KEYS}, round(avg_score, 6) AS avg_score FROM mean_scores"
        ),
        "top10_with_ties": _with(
            ["ranked"],
            "SELECT pres_groups, enrolment_no, round(avg_score, 6) AS avg_score FROM ranked WHERE place <= 10",
        ),
        "degree_share": _with(
            ["shares"],
            "SELECT pres_groups, round(top_share, 6) AS top_share, round(overall_share, 6) AS overall_share FROM shares",
        ),
        "degree_share_totals": _with(
            ["shares"],
            "SELECT round(100.0::DOUBLE * (SELECT CASE WHEN count(top_share) = count(*) "
            "THEN round_even(avg(top_share), 4) END FROM shares WHERE pres_groups NOT IN (2, 4)), 6) AS top_percent, "
            "round(100.0::DOUBLE * (SELECT round_even(avg(ed_dummy), 4) FROM scored), 6) AS overall_percent",
        ),
        "threshold_predict": _with(
            ["ruled"], "SELECT enrolment_no, round(probability_1, 6) AS probability_1, prediction FROM ruled"
        ),
        "confusion_matrix": _with(
            ["ruled"],
            "SELECT pres_groups, "
            + ", ".join(
                f"count(*) FILTER (distinction = {y} AND prediction = {p}) AS {n}"
                for y, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
            )
            + " FROM ruled GROUP BY pres_groups",
        ),
        "class_report": _with(["ruled"], REPORT, {"classes": CLASSES}),
        "one_class_report": _with(
            ["ruled"],
            REPORT.replace("ruled", "single"),
            {
                "single": "SELECT pres_groups, CASE WHEN pres_groups < 6 THEN 0 ELSE distinction END AS distinction, "
                "CASE WHEN pres_groups < 6 THEN 0 ELSE prediction END AS prediction FROM ruled",
                "classes": CLASSES.replace("ruled", "single"),
            },
        ),
    }
