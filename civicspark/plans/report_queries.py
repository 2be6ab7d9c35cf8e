"""Queries of the named reports, over orders published as tables of strings with suppressed numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators.reports import OUT, REPORTS
from civicspark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BASE = """p AS (SELECT o_orderkey AS pos, CAST(year(o_orderdate) AS VARCHAR) AS yr, CASE WHEN o_orderkey % 4 < 3 THEN 'District' ELSE 'School' END AS lvl,
        CASE WHEN (o_orderkey // 4) % 3 < 2 THEN 'All Students' WHEN o_custkey % 5 = 0 THEN 'Non Group' ELSE 'Group ' || (o_custkey % 30) END AS grp,
        CASE (o_orderkey // 16) % 4 WHEN 2 THEN '3rd Grade' WHEN 3 THEN 'Kindergarten' ELSE 'All Grades' END AS grade, o_orderpriority AS kind, CASE o_orderpriority WHEN '1-URGENT' THEN 'Five Year' WHEN '2-HIGH' THEN 'Six Year' ELSE 'Four-Year' END AS cohort, 'School ' || (o_custkey % 40) AS school, o_orderstatus = 'F' AS done,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round_even(o_totalprice, 0) END AS v, CAST(o_custkey AS DOUBLE) AS a, CAST(o_orderkey % 1000 + 1 AS DOUBLE) AS b FROM orders)"""


def _published(s: SparkSession, d: str, names: dict[str, str]) -> DataFrame:
    """Orders as published: names maps the table's columns to yr, lvl, grp, grade, kind, cohort, school, done, v, a or b; numbers are strings, some suppressed."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = F.rint("o_totalprice").cast("bigint").cast("string")
    base = {
        "yr": F.year("o_orderdate").cast("string"), "lvl": F.when(k % 4 < 3, "District").otherwise("School"),
        "grp": F.when(F.floor(k / 4) % 3 < 2, "All Students").when(c % 5 == 0, "Non Group").otherwise(F.concat(F.lit("Group "), (c % 30).cast("string"))),
        "grade": F.when(F.floor(k / 16) % 4 == 2, "3rd Grade").when(F.floor(k / 16) % 4 == 3, "Kindergarten").otherwise("All Grades"), "kind": F.col("o_orderpriority"),
        "cohort": F.when(F.col("o_orderpriority") == "1-URGENT", "Five Year").when(F.col("o_orderpriority") == "2-HIGH", "Six Year").otherwise("Four-Year"),
        "school": F.concat(F.lit("School "), (c % 40).cast("string")), "done": (F.col("o_orderstatus") == "F").cast("string"),
        "v": F.when(k % 11 == 0, "N<20").when(k % 7 == 0, F.concat(F.lit("<"), x, F.lit("%"))).otherwise(x), "a": c.cast("string"), "b": (k % 1000 + 1).cast("string"),
    }
    fixed = lambda v: F.lit(v[1:]) if v.startswith("=") else base[v]
    return table(s, d, "orders").select(k.alias("pos"), *[fixed(v).alias(n) for n, v in names.items()])


def _sec(name: str, where: str, label: str = "''", value: str = "v", part: str = "NULL", whole: str = "NULL", note: str = "NULL", wins: str | None = "last", latest: str | None = None, order: str = "label", top: int | None = None) -> str:
    """A section in SQL; latest is the condition of the rows whose last year counts."""
    cond = f"({where})" + (f" AND yr = (SELECT max(yr) FROM p WHERE {latest})" if latest else "")
    cols = f"{value} AS value, {part} AS part, {whole} AS whole, {note} AS note"
    pick = "" if wins is None else f" QUALIFY row_number() OVER (PARTITION BY yr, {label} ORDER BY pos {'DESC' if wins == 'last' else 'ASC'}) = 1"
    by = {"label": "label", "value": "coalesce(value, 0) DESC, label", "least": "value, label", "note": "note, label"}.get(order, order)
    cut = f" QUALIFY place <= {top}" if top else ""
    return f"SELECT '{name}' AS section, yr AS year, label, CAST(value AS DOUBLE) AS value, CAST(part AS DOUBLE) AS part, CAST(whole AS DOUBLE) AS whole, note, CAST(row_number() OVER (PARTITION BY yr ORDER BY {by}, pos) AS INT) AS place FROM (SELECT yr, {label} AS label, {cols}, pos FROM p WHERE {cond}{pick}){cut}"


def _report(name: str, report: str, names: dict[str, str], *sections: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = REPORTS[report].build(_published(s, d, names), "pos")
        return out.select(*[F.round(c, 6).alias(c) if c in ("value", "part", "whole") else c for c in OUT])

    QUERIES[name] = run
    shown = "section, year, label, round(value, 6) AS value, round(part, 6) AS part, round(whole, 6) AS whole, CAST(note AS VARCHAR) AS note, place"
    SQL[name] = f"WITH {_BASE} " + " UNION ALL ".join(f"SELECT {shown} FROM ({x})" for x in sections)


_D, _E, _A = "lvl = 'District'", "grp = 'All Students'", "grade = 'All Grades'"
_LAST = f"SELECT yr, v, a, b FROM p WHERE {_D} AND {_A} QUALIFY row_number() OVER (PARTITION BY yr ORDER BY pos) = 1"
_RACES = ("White", "Asian", "Hispanic/Latino", "Black/African American", "Two or More Races", "Native Hawaiian/Pacific Islander", "American Indian/Alaska Native")
_PLACES = ("English Language Learners", "Low Income", "Students with Disabilities", "Section 504", "Homeless", "Foster Care", "Migrant", "Military Parent", "Highly Capable")


def _mix(name: str, labels: tuple[str, ...]) -> str:
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels, 1))
    return f"SELECT '{name}' AS section, yr AS year, x.label, a AS value, CASE WHEN v > 0 THEN round(100 * a / v, 1) END AS part, v AS whole, NULL AS note, CAST(i AS INT) AS place FROM (SELECT * FROM ({_LAST}) ORDER BY yr DESC LIMIT 1), (VALUES {rows}) x(i, label)"


_SHIFT = f"""SELECT 'shift' AS section, y2 AS year, x.label, l - f AS value, f AS part, l AS whole, CASE WHEN l - f > 0 THEN '+' ELSE '' END AS note, CAST(i AS INT) AS place
    FROM (SELECT arg_min(a, yr) AS f, arg_max(a, yr) AS l, max(yr) AS y2 FROM ({_LAST})), (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate((*_RACES[:4], _PLACES[0]), 1))}) x(i, label)"""
_report(
    "rollup_enrollment", "enrollment",
    {"schoolyear": "yr", "organizationlevel": "lvl", "gradelevel": "grade", "schoolname": "school", "all_students": "v", "female": "a", "male": "b"}
    | {c: "a" for c in ("white", "asian", "hispanic_latino_of_any_race_s_", "black_african_american", "two_or_more_races", "native_hawaiian_other_pacific_islander", "american_indian_alaskan_native", "english_language_learners", "low_income", "students_with_disabilities", "section_504", "homeless", "foster_care", "migrant", "military_parent", "highly_capable")},
    _sec("trend", f"{_D} AND {_A}", part="a", whole="b", wins="first"),
    _sec("grades", f"{_D} AND NOT {_A}", "grade", latest=f"{_D} AND {_A}", order="CASE label WHEN 'Kindergarten' THEN 1 ELSE 2 END"),
    _sec("schools", f"lvl = 'School' AND {_A}", "school", wins=None, latest=f"{_D} AND {_A}", order="value"),
    _mix("composition", _RACES), _mix("populations", _PLACES), _SHIFT,
)
_report(
    "rollup_assessment", "assessment", {"schoolyear": "yr", "organizationlevel": "lvl", "studentgroup": "grp", "gradelevel": "grade", "testsubject": "=ELA", "percentmetstandard": "v", "countmetstandard": "a", "countofstudentsexpectedtotestingroup": "b"},
    _sec("grades ELA", f"{_D} AND {_E} AND NOT {_A}", "grade", latest=f"{_D} AND {_E}"), _sec("groups ELA", f"{_D} AND {_A} AND NOT {_E}", "grp", wins=None, latest=f"{_D} AND {_E}", order="value", top=20),
    _sec("trend", f"{_D} AND {_E} AND {_A}", "'ELA'", part="a", whole="b"),
)
_report(
    "rollup_assessment_loose", "assessment", {"schoolyear": "yr", "organizationlevel": "lvl", "studentgroup": "grp", "gradelevel": "=all of them", "testsubject": "=Math", "percentlevel3": "v", "countmetstandard": "a"},
    _sec("grades Math", f"{_D} AND {_E}", "'all of them'", latest=f"{_D} AND {_E}"), _sec("trend", f"{_D} AND {_E}", "'Math'", part="a"),
)
_FOUR = f"{_D} AND {_E} AND cohort = 'Four-Year'"
_report(
    "rollup_graduation", "graduation", {"schoolyear": "yr", "organizationlevel": "lvl", "studentgroup": "grp", "cohort": "cohort", "graduationrate": "v", "graduate": "a", "finalcohort": "b"},
    _sec("trend", _FOUR, part="a", whole="b"), _sec("groups", f"{_D} AND NOT {_E} AND cohort = 'Four-Year'", "grp", wins=None, latest=_FOUR, order="value", top=25),
    _sec("extended", f"{_D} AND {_E} AND cohort <> 'Four-Year'", "cohort", wins=None, latest=_FOUR),
)
_report(
    "rollup_attendance", "attendance", {"reportingyear": "yr", "organizationlevel": "lvl", "studentgroup": "grp", "gradelevel": "grade", "rate": "v", "numerator": "a", "denominator": "b"},
    _sec("trend", f"{_D} AND {_E} AND {_A}", part="a", whole="b"), _sec("grades", f"{_D} AND {_E} AND NOT {_A}", "grade", wins=None, latest=f"{_D} AND {_E} AND {_A}"),
    _sec("groups", f"{_D} AND NOT {_E} AND {_A}", "grp", wins=None, latest=f"{_D} AND {_E} AND {_A}", order="value", top=20),
)
_report(
    "rollup_discipline", "discipline", {"schoolyear": "yr", "organizationlevel": "lvl", "student_group": "grp", "gradelevel": "grade", "disciplinerate": "v", "disciplinenumerator": "a", "disciplinedenominator": "b"},
    _sec("trend", f"{_D} AND {_E} AND {_A}", part="a", whole="b"), _sec("grades", f"{_D} AND {_E} AND NOT {_A}", "grade", part="a", wins=None, latest=f"{_D} AND {_E} AND {_A}"),
)
_report(
    "rollup_teachers", "teachers", {"schoolyear": "yr", "organizationlevel": "lvl", "race_ethnicity": "kind", "teachercount": "v", "teacherpercent": "a", "avgexperience": "b"},
    _sec("mix", _D, "kind", part="a", whole="b", wins=None, latest=_D, order="value"),
    f"SELECT 'totals' AS section, yr AS year, '' AS label, sum(v) AS value, count(*) AS part, NULL AS whole, NULL AS note, 1::INT AS place FROM p WHERE {_D} GROUP BY yr HAVING sum(v) > 0",
)
_report("rollup_teacher_experience", "teacher_experience", {"schoolyear": "yr", "organizationlevel": "lvl", "experiencerange": "kind", "countofteachers": "v", "percentofteachers": "a"}, _sec("bands", _D, "kind", part="a", wins=None, latest=_D))
_report(
    "rollup_quality_indicators", "quality_indicators", {"schoolyear": "yr", "organizationlevel": "lvl", "studentgroup": "grp", "measures": "=Dual Credit", "percent": "v", "numerator": "a", "denominator": "b"},
    _sec("trend", f"{_D} AND {_E}", "'Dual Credit'", part="a", whole="b"),
)
_report(
    "rollup_growth", "growth", {"schoolyear": "yr", "organizationlevel": "lvl", "studentgroup": "grp", "subject": "=Math", "gradelevel": "grade", "mediansgp": "v", "studentcount": "a"}, _sec("grades Math", f"{_D} AND {_E}", "grade", part="a", latest=f"{_D} AND {_E}"),
)
_report(
    "rollup_readiness", "readiness", {"schoolyear": "yr", "organizationlevel": "lvl", "studentgroup": "grp", "subdomain": "kind", "percentready": "v", "countready": "a", "counttested": "b"},
    _sec("trend", f"{_D} AND {_E}", "kind", part="a", whole="b"), _sec("detail", f"{_D} AND {_E}", "kind", part="a", whole="b", latest=f"{_D} AND {_E}"),
)


def _group_rates(where: str) -> str:
    return f"SELECT 'groups' AS section, NULL AS year, label, 100 * x / y AS value, x AS part, y AS whole, NULL AS note, CAST(row_number() OVER (ORDER BY 100 * x / y DESC, label) AS INT) AS place FROM (SELECT grp AS label, sum(a) AS x, sum(b) AS y FROM p WHERE {where} AND grp NOT LIKE 'Non%' AND NOT {_E} GROUP BY 1 HAVING sum(b) > 0)"


_capable = {"schoolyear": "yr", "studentgroup": "grp", "schoolname": "school", "highlycapablerate": "v", "highlycapabletotal": "a", "totalstudents": "b"}
_report("rollup_highly_capable", "highly_capable", _capable | {"orglevel": "lvl"}, _sec("schools", f"lvl = 'School' AND {_E}", "school", part="a", whole="b", wins=None, order="value"), _group_rates(_D))
_report("rollup_highly_capable_schools", "highly_capable", _capable | {"orglevel": "=school"}, _sec("schools", _E, "school", part="a", whole="b", wins=None, order="value"), _group_rates("true"))
_report(
    "rollup_improvement", "improvement", {"wsif_year": "yr", "student_group": "grp", "school_name": "school", "_2022_support_tier": "kind", "regularattendance_rate": "v", "grad_fouryear_rate": "a", "sqss_combined_decile": "v"},
    _sec("ranking", _E, "school", value="coalesce(v, 5)", note="kind", wins=None, order="least"),
    f"SELECT 'tiers' AS section, NULL AS year, kind AS label, count(*) AS value, NULL AS part, NULL AS whole, NULL AS note, CAST(row_number() OVER (ORDER BY kind) AS INT) AS place FROM p WHERE {_E} GROUP BY kind",
)
_report(
    "rollup_interventions", "improvement", {"wsif_year": "yr", "student_group": "grp", "school_name": "school", "_2022_support_tier": "=Targeted 3+", "regularattendance_rate": "v", "grad_fouryear_rate": "a"},
    _sec("interventions", _E, "school", part="a", note="'Targeted 3+'", wins=None, order="note"),
    f"SELECT 'tiers' AS section, NULL AS year, 'Targeted 3+' AS label, count(*) AS value, NULL AS part, NULL AS whole, NULL AS note, 1::INT AS place FROM p WHERE {_E} HAVING count(*) > 0",
)
_learners = {"schoolyear": "yr", "orglevel": "lvl", "proficientlabel": "v", "proficientdenominatordat": "b"}
_report(
    "rollup_language_tests", "language_tests", _learners | {"test": "=WIDAACC", "gradelevel": "grade"},
    _sec("grades", f"{_D} AND NOT {_A}", "grade", whole="b", latest=_D, order="CASE label WHEN 'Kindergarten' THEN 1 ELSE 2 END"), _sec("trend", f"{_D} AND {_A}", "grade", whole="b"),
)
_report("rollup_language_tests_by_grade", "language_tests", _learners | {"test": "=WIDAACC", "gradelevel": "kind"}, _sec("grades", _D, "kind", whole="b", latest=_D), _sec("trend", _D, "kind", whole="b"))
_report("rollup_language_tests_alternate", "language_tests", _learners | {"test": "=WIDAALT", "gradelevel": "grade"}, _sec("alternate", _D, "grade", whole="b", wins=None))
_report(
    "rollup_expenditure", "expenditure", {"school_year_code": "yr", "total_ppe": "v", "enrollment": "a", "total_expenditures1": "b", "federal_ppe": "b"}, _sec("trend", "true", part="a", whole="b", wins=None),
    "SELECT 'change' AS section, y2 AS year, y1 AS label, 100 * (l - f) / f AS value, f AS part, l AS whole, NULL AS note, 1::INT AS place FROM (SELECT arg_min(coalesce(v, 0), (yr, pos)) AS f, arg_max(coalesce(v, 0), (yr, pos)) AS l, min(yr) AS y1, max(yr) AS y2 FROM p) WHERE f <> 0",
)
_report(
    "rollup_grants", "grants", {"school_year": "yr", "school_name": "school", "_1003_award": "v", "teaching": "done", "curriculum": "=true"},
    "SELECT 'totals' AS section, yr AS year, '' AS label, sum(coalesce(v, 0)) AS value, count(*) AS part, NULL AS whole, NULL AS note, 1::INT AS place FROM p GROUP BY yr",
    _sec("schools", "true", "school", value="coalesce(v, 0)", note="CASE WHEN done THEN 'Teaching, Curriculum' ELSE 'Curriculum' END", wins=None, order="coalesce(value, 0) DESC"),
)
