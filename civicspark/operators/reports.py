"""Named roll-ups of published statistics, declared as sections of a report.

The tables hold strings, with column names and marks of suppression that vary by year. A section says which rows it takes, what
labels them, which numbers it shows and in which order; a report is the union of its sections. All steps are
aggregates, equi-joins and windows over a section's own result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import suppressed_number
from civicspark.operators.rollups import either, flags

Names = tuple[str, ...]
Rule = Callable[[DataFrame], Column]

OUT = ["section", "year", "label", "value", "part", "whole", "note", "place"]


def number(c: Column, missing: float | None = None) -> Column:
    """A published number; suppressed, damaged and absent ones are `missing` (null)."""
    v = F.nullif(suppressed_number(c, -1e300), F.lit(-1e300))
    return v if missing is None else F.coalesce(v, F.lit(missing))


def is_in(names: Names, *values: str | None) -> Rule:
    """Rows whose first present column of names has one of the values; None stands for null and ''."""
    def rule(df: DataFrame) -> Column:
        c = F.coalesce(either(df, *names), F.lit(""))
        return c.isin([v or "" for v in values])

    return rule


def has(names: Names, *parts: str) -> Rule:
    """Rows whose column contains one of the parts, in any case."""
    return lambda df: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(either(df, *names), F.lit(""))), F.lit(p.lower())) for p in parts])


def starts(names: Names, part: str) -> Rule:
    return lambda df: F.coalesce(either(df, *names), F.lit("")).startswith(part)


def no(rule: Rule) -> Rule:
    return lambda df: ~rule(df)


def where(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return reduce(lambda x, r: x.where(r(df)), rules, df)


def first_that_has_rows(df: DataFrame, *choices: tuple[Rule, ...]) -> DataFrame:
    """The rows of the first choice of rules that has any; decided by one aggregate in the plan, not by a driver's look."""
    tagged = df.withColumn("__choice", F.array_compact(F.array(*[F.when(reduce(lambda a, b: a & b, [r(df) for r in rules]), F.lit(k)) for k, rules in enumerate(choices)])))
    best = tagged.agg(F.min(F.array_min("__choice")).alias("__best"))
    return tagged.join(F.broadcast(best), F.lit(True)).where(F.array_contains("__choice", F.col("__best"))).drop("__choice", "__best")


@dataclass(frozen=True)
class Section:
    """year and label name columns (first present one counts); wins settles rows of one year and label ('first', 'last' or None for all).

    latest keeps the last year that rows under `years` (or the section's own) have. order: 'label', 'note', 'value' (greatest
    first, absent as 0), 'least' (value) or a list of labels, of which others come after by name, or are left out if strict.
    """

    name: str
    rules: tuple[Rule, ...] = ()
    year: Names = ("schoolyear", "school_year", "reportingyear", "year")
    label: Names = ()
    value: Names = ()
    part: Names = ()
    whole: Names = ()
    note: Names = ()
    wins: str | None = "last"
    latest: bool = False
    years: tuple[Rule, ...] | None = None
    order: str | tuple[str, ...] = "label"
    strict: bool = False
    top: int | None = None
    missing: float | None = None

    def rows(self, df: DataFrame, position: str) -> DataFrame:
        """(year, label, value, part, whole, note, pos), unordered."""
        x = where(df, self.rules)
        got = x.select(
            F.coalesce(either(x, *self.year), F.lit("")).alias("year"), (F.coalesce(either(x, *self.label), F.lit("")) if self.label else F.lit("")).alias("label"),
            *[number(either(x, *n), self.missing if k == "value" else None).alias(k) for k, n in (("value", self.value), ("part", self.part), ("whole", self.whole))], either(x, *self.note).cast("string").alias("note"), F.col(position).alias("pos"),
        )
        if self.wins:
            pick = F.min_by if self.wins == "first" else F.max_by
            got = got.groupBy("year", "label").agg(pick(F.struct("value", "part", "whole", "note", "pos"), "pos").alias("r")).select("year", "label", "r.*")
        if self.latest:
            y = where(df, self.years) if self.years is not None else x
            top = y.agg(F.max(F.coalesce(either(y, *self.year), F.lit(""))).alias("year"))
            got = got.join(F.broadcast(top), "year", "left_semi")
        return got

    def build(self, df: DataFrame, position: str) -> DataFrame:
        return self.placed(self.rows(df, position))

    def placed(self, got: DataFrame) -> DataFrame:
        if isinstance(self.order, tuple):
            at = F.array_position(F.array(*map(F.lit, self.order)), F.col("label"))
            got = got.where(at > 0) if self.strict else got
            by = [F.when(at > 0, at).otherwise(len(self.order) + 1), F.col("label")]
        else:
            by = {"value": [F.desc(F.coalesce("value", F.lit(0.0))), F.col("label")], "least": [F.col("value"), F.col("label")], "note": [F.col("note"), F.col("label")], "label": [F.col("label")]}[self.order]
        got = got.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy(*by, "pos")))
        if self.top:
            got = got.where(F.col("place") <= self.top)
        return got.select(F.lit(self.name).alias("section"), *OUT[1:])


@dataclass(frozen=True)
class Report:
    name: str
    sections: tuple[Section, ...] = ()
    more: tuple[Callable[[DataFrame, str], DataFrame], ...] = field(default=())

    def build(self, df: DataFrame, position: str) -> DataFrame:
        """(section, year, label, value, part, whole, note, place); a table without rows gives none."""
        return reduce(DataFrame.unionByName, [s.build(df, position) for s in self.sections] + [f(df, position) for f in self.more])


def _shown(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """A section of computed columns; absent ones are null."""
    kinds = {"year": "string", "label": "string", "value": "double", "part": "double", "whole": "double", "note": "string", "place": "int"}
    return df.select(F.lit(name).alias("section"), *[columns.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def composition(name: str, base: Section, columns: dict[str, str], total: str) -> Callable[[DataFrame, str], DataFrame]:
    """Columns of the base section's last year as rows: value, whole (the total) and the share in percent as `part`."""

    def build(df: DataFrame, position: str) -> DataFrame:
        last = _wide(base, df, position, [*columns, total])
        top = last.agg(F.max("year").alias("year"))
        rows = last.join(F.broadcast(top), "year", "left_semi").select("year", F.col(total).alias("t"), F.posexplode(F.array(*[F.struct(F.lit(lab).alias("label"), F.col(c).alias("v")) for c, lab in columns.items()])).alias("i", "x"))
        return _shown(rows, name, year=F.col("year"), label=F.col("x.label"), value=F.col("x.v"), part=F.when(F.col("t") > 0, F.round(100 * F.col("x.v") / F.col("t"), 1)), whole=F.col("t"), place=F.col("i") + 1)

    return build


def shift(name: str, base: Section, columns: dict[str, str]) -> Callable[[DataFrame, str], DataFrame]:
    """Columns of the base section's first and last year: value is the difference, part the first and whole the last value, note its sign.

    Absent numbers count as 0; a table of one year has no rows.
    """

    def build(df: DataFrame, position: str) -> DataFrame:
        w = _wide(base, df, position, list(columns))
        long = w.select("year", F.posexplode(F.array(*[F.struct(F.lit(lab).alias("label"), F.coalesce(F.col(c), F.lit(0.0)).alias("v")) for c, lab in columns.items()])).alias("i", "x"))
        g = long.groupBy("i", "x.label").agg(F.min_by("x.v", "year").alias("a"), F.max_by("x.v", "year").alias("b"), F.min("year").alias("y1"), F.max("year").alias("y2")).where("y1 <> y2")
        d = F.col("b") - F.col("a")
        return _shown(g, name, year=F.col("y2"), label=F.col("label"), value=d, part=F.col("a"), whole=F.col("b"), note=F.when(d > 0, "+").otherwise(""), place=F.col("i") + 1)

    return build


def _wide(base: Section, df: DataFrame, position: str, columns: list[str]) -> DataFrame:
    x = where(df, base.rules)
    got = x.select(F.coalesce(either(x, *base.year), F.lit("")).alias("year"), *[number(either(x, c)).alias(c) for c in columns], F.col(position).alias("pos"))
    pick = F.min_by if base.wins == "first" else F.max_by
    return got.groupBy("year").agg(pick(F.struct(*columns), "pos").alias("r")).select("year", "r.*")


def per_year(name: str, rules: tuple[Rule, ...], year: Names, value: Names, positive: bool = True) -> Callable[[DataFrame, str], DataFrame]:
    """Sum of a number by year, with the number of rows as `part`; years with a sum of 0 are left out if positive."""

    def build(df: DataFrame, position: str) -> DataFrame:
        x = where(df, rules)
        g = x.groupBy(F.coalesce(either(x, *year), F.lit("")).alias("y")).agg(F.sum(number(either(x, *value), 0.0)).alias("v"), F.count("*").alias("n"))
        return _shown(g.where("v > 0") if positive else g, name, year=F.col("y"), label=F.lit(""), value=F.col("v"), part=F.col("n"), place=F.lit(1))

    return build


def group_rates(name: str, choices: tuple[tuple[Rule, ...], ...], label: Names, part: Names, whole: Names) -> Callable[[DataFrame, str], DataFrame]:
    """Sums of two numbers by label over the first choice of rows that there is, and their rate in percent, greatest first; labels without a whole are left out."""

    def build(df: DataFrame, position: str) -> DataFrame:
        x = first_that_has_rows(df, *choices)
        g = x.groupBy(F.coalesce(either(x, *label), F.lit("")).alias("label")).agg(F.sum(number(either(x, *part), 0.0)).alias("a"), F.sum(number(either(x, *whole), 0.0)).alias("b")).where("b > 0")
        rate = 100 * F.col("a") / F.col("b")
        g = g.withColumn("rate", rate).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rate"), "label")))
        return _shown(g, name, label=F.col("label"), value=F.col("rate"), part=F.col("a"), whole=F.col("b"), place=F.col("place"))

    return build


def counts(name: str, rules: tuple[Rule, ...], label: Names, order: tuple[str, ...]) -> Callable[[DataFrame, str], DataFrame]:
    """How many rows each non-empty label has, listed labels first."""

    def build(df: DataFrame, position: str) -> DataFrame:
        x = where(df, rules)
        g = x.groupBy(either(x, *label).alias("label")).agg(F.count("*").alias("n")).where("label <> ''")
        at = F.array_position(F.array(*map(F.lit, order)), F.col("label"))
        return _shown(g, name, label=F.col("label"), value=F.col("n"), place=F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.when(at > 0, at).otherwise(len(order) + 1), "label")))

    return build


def first_to_last(name: str, year: Names, value: Names, peak: Names = (), peak_years: tuple[str, ...] = (), factor: float = 1.3) -> Callable[[DataFrame, str], DataFrame]:
    """Change of a number from the first to the last year in percent; note is 'peaked' if another one, within peak_years, rose above factor times its first value."""

    def build(df: DataFrame, position: str) -> DataFrame:
        y = F.coalesce(either(df, *year), F.lit(""))
        x = df.select(y.alias("y"), number(either(df, *value), 0.0).alias("v"), number(either(df, *peak), 0.0).alias("p"), F.struct(y, F.col(position)).alias("o"))
        g = x.agg(F.min_by("v", "o").alias("a"), F.max_by("v", "o").alias("b"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count("*").alias("n"), F.max(F.when(F.col("y").isin(*peak_years), F.col("p"))).alias("top"), F.min_by("p", "o").alias("p1"))
        g = g.where("n >= 2 and a <> 0")
        return _shown(g, name, year=F.col("y2"), label=F.col("y1"), value=100 * (F.col("b") - F.col("a")) / F.col("a"), part=F.col("a"), whole=F.col("b"), note=F.when(F.col("top") > factor * F.col("p1"), "peaked"), place=F.lit(1))

    return build


def flagged(name: str, year: Names, label: Names, value: Names, marks: dict[str, str]) -> Callable[[DataFrame, str], DataFrame]:
    """Rows by year, greatest value first (absent as 0), with the names of the columns that say true as the note."""

    def build(df: DataFrame, position: str) -> DataFrame:
        true = [(F.lower(F.coalesce(either(df, c).cast("string"), F.lit(""))) == "true", lab) for c, lab in marks.items()]
        x = df.select(F.coalesce(either(df, *year), F.lit("Unknown")).alias("y"), F.coalesce(either(df, *label), F.lit("Unknown")).alias("l"), number(either(df, *value), 0.0).alias("v"), flags(true).alias("m"), F.col(position).alias("pos"))
        return _shown(x.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("v"), "pos"))), name, year=F.col("y"), label=F.col("l"), value=F.col("v"), note=F.col("m"), place=F.col("place"))

    return build


# --- the reports; names of columns and the values that select rows are fixed values of the published tables ---------------

LEVEL, GROUP, GRADE, SCHOOL = ("organizationlevel", "orglevel"), ("studentgroup", "student_group"), ("gradelevel",), ("schoolname", "school_name")
DISTRICT, EVERYONE = is_in(LEVEL, "District", "district"), is_in(GROUP, "All Students")
ALL_GRADES = is_in(GRADE, "All Grades")
GRADES = ("Pre-Kindergarten", "Kindergarten", "1st Grade", "2nd Grade", "3rd Grade", "4th Grade", "5th Grade", "6th Grade", "7th Grade", "8th Grade", "9th Grade", "10th Grade", "11th Grade", "12th Grade")
RACES = {
    "white": "White", "asian": "Asian", "hispanic_latino_of_any_race_s_": "Hispanic/Latino", "black_african_american": "Black/African American", "two_or_more_races": "Two or More Races",
    "native_hawaiian_other_pacific_islander": "Native Hawaiian/Pacific Islander", "american_indian_alaskan_native": "American Indian/Alaska Native",
}
SPECIAL = {
    "english_language_learners": "English Language Learners", "low_income": "Low Income", "students_with_disabilities": "Students with Disabilities", "section_504": "Section 504", "homeless": "Homeless",
    "foster_care": "Foster Care", "migrant": "Migrant", "military_parent": "Military Parent", "highly_capable": "Highly Capable",
}
SHIFTED = {k: RACES[k] for k in list(RACES)[:4]} | {"english_language_learners": SPECIAL["english_language_learners"]}
FOUR_YEARS = is_in(("cohort",), "Four Year", "Four-Year", "4")
MET = ("percentmetstandard", "percentlevel3")
REGULAR = ("percentregularattenders", "percentmetstandard", "rate")
TIERS = ("Foundational Supports", "Targeted 1-2", "Targeted 3+", "Comprehensive", "Comprehensive_LowGrad")
TIER, WIDA = ("_2022_support_tier", "_2022_cycle_support"), is_in(("test",), "WIDAACC")
PROFICIENT, TESTED = ("proficientlabel", "metstandarddat"), ("proficientdenominatordat", "metstandarddenominatordat")
SPENT = {
    "teaching": "Teaching", "instructional_professional": "Professional Development", "curriculum": "Curriculum", "guidance_and_counseling": "Counseling", "pupil_management_and_safety": "Pupil Safety",
    "instructional_technology": "Technology", "health_related_services": "Health Services", "learning_resources": "Learning Resources",
}

_enrolled = Section("trend", (DISTRICT, ALL_GRADES), value=("all_students",), part=("female",), whole=("male",), wins="first")
_met = (DISTRICT, EVERYONE, is_in(("studentgrouptypeinchart",), "All", "AllStudents", None))
_four = (DISTRICT, EVERYONE, FOUR_YEARS)
_attending = (DISTRICT, EVERYONE, is_in(GRADE, "All Grades", None))
_excluded = (DISTRICT, EVERYONE, is_in(GRADE, "All Grades", "All", None))
_teachers = is_in(LEVEL, "District", "LEA")
_schools = (is_in(LEVEL, "School", "school"), EVERYONE)
_groups = (no(EVERYONE), no(starts(GROUP, "Non")))


def _subject_trends(df: DataFrame, position: str) -> DataFrame:
    """A trend per subject over all grades; a subject without such rows takes those whose grade says 'all' somewhere."""
    x = where(df, (*_met, is_in(("testsubject",), "ELA", "Math", "Science")))
    exact, loose = ALL_GRADES(x), has(GRADE, "all")(x)
    x = x.withColumn("__subject", F.coalesce(either(x, "testsubject"), F.lit(""))).withColumn("__grade", F.coalesce(either(x, *GRADE), F.lit("")))
    some = x.groupBy("__subject").agg(F.bool_or(exact).alias("__exact"))
    kept = x.join(F.broadcast(some), "__subject").where(F.when(F.col("__exact"), exact).otherwise(loose))
    s = Section("trend", label=("testsubject",), value=MET, part=("countmetstandard",), whole=("countofstudentsexpectedtotestingroup",))
    by_grade = Section("trend", label=("__key",), value=s.value, part=s.part, whole=s.whole)
    rows = by_grade.rows(kept.withColumn("__key", F.concat_ws("\u001f", "__subject", "__grade")), position).withColumn("label", F.element_at(F.split("label", "\u001f"), 1))
    return s.placed(rows)


def _english_learners(df: DataFrame, position: str) -> DataFrame:
    """WIDA ACCESS by year over all grades, or by grade where a table has no such row at all."""
    rows = first_that_has_rows(df, (DISTRICT, WIDA, ALL_GRADES), (DISTRICT, WIDA))
    return Section("trend", label=GRADE, value=PROFICIENT, whole=TESTED).build(rows, position)


_SUBJECT_GRADES = tuple(Section(f"grades {s}", (*_met, is_in(("testsubject",), s), no(ALL_GRADES)), label=GRADE, value=MET, latest=True, years=_met) for s in ("ELA", "Math", "Science"))
_SUBJECT_GROUPS = tuple(Section(f"groups {s}", (DISTRICT, ALL_GRADES, no(EVERYONE), is_in(("testsubject",), s)), label=GROUP, value=MET, wins=None, latest=True, years=_met, order="value", top=20) for s in ("ELA", "Math"))

REPORTS = {
    r.name: r
    for r in (
        Report("enrollment", (
            _enrolled,
            Section("grades", (DISTRICT, no(is_in(GRADE, "All Grades", None))), label=GRADE, value=("all_students",), latest=True, years=_enrolled.rules, order=GRADES, strict=True),
            Section("schools", (is_in(LEVEL, "School"), ALL_GRADES), label=SCHOOL, value=("all_students",), wins=None, latest=True, years=_enrolled.rules, order="value"),
        ), (composition("composition", _enrolled, RACES, "all_students"), composition("populations", _enrolled, SPECIAL, "all_students"), shift("shift", _enrolled, SHIFTED))),
        Report("assessment", (*_SUBJECT_GRADES, *_SUBJECT_GROUPS), (_subject_trends,)),
        Report("graduation", (
            Section("trend", _four, value=("graduationrate",), part=("graduate",), whole=("finalcohort",)),
            Section("groups", (DISTRICT, FOUR_YEARS, no(EVERYONE)), label=GROUP, value=("graduationrate",), wins=None, latest=True, years=_four, order="value", top=25),
            Section("extended", (DISTRICT, EVERYONE, no(FOUR_YEARS)), label=("cohort",), value=("graduationrate",), wins=None, latest=True, years=_four),
        )),
        Report("attendance", (
            Section("trend", _attending, value=REGULAR, part=("numerator", "numberregularattenders"), whole=("denominator", "numberstudents")),
            Section("grades", (DISTRICT, EVERYONE, no(is_in(GRADE, "All Grades", None))), label=GRADE, value=REGULAR, wins=None, latest=True, years=_attending),
            Section("groups", (DISTRICT, no(EVERYONE), is_in(GRADE, "All Grades", None)), label=GROUP, value=REGULAR, wins=None, latest=True, years=_attending, order="value", top=20),
        )),
        Report("discipline", (
            Section("trend", _excluded, value=("disciplinerate",), part=("disciplinenumerator",), whole=("disciplinedenominator",)),
            Section("grades", (DISTRICT, EVERYONE, no(is_in(GRADE, "All Grades", "All", None))), label=GRADE, value=("disciplinerate",), part=("disciplinenumerator",), wins=None, latest=True, years=_excluded),
        )),
        Report("teachers", (
            Section("mix", (_teachers,), label=("raceethnicity", "race_ethnicity"), value=("countofteachers", "teachercount"), part=("percentofteachers", "teacherpercent"), whole=("averageexperience", "avgexperience"), wins=None, latest=True, order="value"),
        ), (per_year("totals", (_teachers,), ("schoolyear",), ("countofteachers", "teachercount")),)),
        Report("teacher_experience", (Section("bands", (_teachers,), label=("experiencerange", "experience_range"), value=("countofteachers", "teachercount"), part=("percentofteachers", "teacherpercent"), wins=None, latest=True),)),
        Report("quality_indicators", (
            Section("trend", (DISTRICT, EVERYONE, is_in(("measure", "measures"), "Dual Credit", "9th Grade on Track")), label=("measure", "measures"), value=("percentmetstandard", "rate", "percent"), part=("numerator",), whole=("denominator",)),
        )),
        Report("growth", tuple(Section(f"grades {s}", (DISTRICT, EVERYONE, is_in(("subject",), s)), label=GRADE, value=("mediansgp",), part=("studentcount",), latest=True) for s in ("English Language Arts", "Math"))),
        Report("readiness", tuple(Section(n, (DISTRICT, EVERYONE, no(is_in(("domain", "subdomain"), None)), no(is_in(("schoolyear",), None))), label=("domain", "subdomain"), value=("percentmetstandard", "percentready", "percent"), part=("numerator", "countready"), whole=("denominator", "counttested"), latest=n == "detail") for n in ("trend", "detail"))),
        Report("highly_capable", (Section("schools", _schools, label=SCHOOL, value=("highlycapablerate",), part=("highlycapabletotal",), whole=("totalstudents",), wins=None, order="value"),), (
            group_rates("groups", ((DISTRICT, *_groups), (is_in(LEVEL, "School", "school"), *_groups)), GROUP, ("highlycapabletotal",), ("totalstudents",)),
        )),
        Report("improvement", (
            Section("interventions", (EVERYONE, has(TIER[:1], "Targeted 3+", "Targeted_EL", "Comprehensive")), year=("wsif_year",), label=SCHOOL, value=("regularattendance_rate",), part=("grad_fouryear_rate",), note=TIER[:1], wins=None, order="note"),
            Section("ranking", (EVERYONE, no(is_in(("sqss_combined_decile",), None))), year=("wsif_year",), label=SCHOOL, value=("sqss_combined_decile",), note=TIER[:1], wins=None, missing=5.0, order="least"),
        ), (counts("tiers", (EVERYONE,), TIER, TIERS),)),
        Report("language_tests", (
            Section("grades", (DISTRICT, WIDA, no(is_in(GRADE, "All Grades", None))), label=GRADE, value=PROFICIENT, whole=TESTED, latest=True, years=(DISTRICT, WIDA), order=GRADES[1:]),
            Section("alternate", (DISTRICT, is_in(("test",), "WIDAALT")), label=GRADE, value=PROFICIENT, whole=TESTED, wins=None),
            Section("historical", (DISTRICT, is_in(("test",), "ELPA")), label=GRADE, value=PROFICIENT[::-1], whole=TESTED[::-1], wins=None),
        ), (_english_learners,)),
        Report("expenditure", (Section("trend", year=("school_year_code",), value=("total_ppe",), part=("enrollment",), whole=("total_expenditures1",), wins=None),), (
            first_to_last("change", ("school_year_code",), ("total_ppe",), ("federal_ppe",), ("2021-22", "2022-23")),
        )),
        Report("grants", (), (per_year("totals", (), ("schoolyear", "school_year"), ("_1003_award",), False), flagged("schools", ("schoolyear", "school_year"), SCHOOL, ("_1003_award",), SPENT))),
    )
}
