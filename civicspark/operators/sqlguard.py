"""A guard for SQL from outside: one read-only query over listed views, decided on the parsed plan, not on its text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Functions that reach outside the query.
DENIED_FUNCTIONS = ("java_method", "reflect", "try_reflect", "read_files", "input_file_name", "current_user", "session_user")


class Refused(ValueError):
    """The query is not allowed."""


def check(spark: SparkSession, sql: str, views: set[str]) -> None:
    """Raise Refused unless sql is a single query that reads nothing but `views` (and its own common table expressions)."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(f"not a query: {str(e).splitlines()[0]}") from None
    tree = plan.treeString()
    nodes = set(re.findall(r"(?m)^[\s:|+\-]*'?([A-Z]\w+)", tree))
    kind = plan.getClass().getName()
    if "Command" in kind or "command" in kind or "Statement" in kind or re.search(r"\.(Create|Insert|Drop|Alter|Delete|Update|Merge|Set|Show|Describe|Truncate|Refresh|Cache|Uncache|Load|Use|Replace|Overwrite|Append)\w*$", kind):
        raise Refused(f"not a read-only query: {kind.rpartition('.')[2]}")
    if bad := nodes & {"InsertIntoStatement", "ScriptTransformation", "UnresolvedTableValuedFunction"}:
        raise Refused(f"not allowed: {', '.join(sorted(bad))}")
    own = {x.strip() for m in re.findall(r"CTE \[([^\]]*)\]", tree) for x in m.split(",")}
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", tree):
        full = ".".join(p.strip() for p in name.split(","))
        if full not in views and full not in own:
            raise Refused(f"unknown relation {full}")
    if f := next((f for f in DENIED_FUNCTIONS if re.search(rf"'{f}\(", tree)), None):
        raise Refused(f"function {f}")


def run(spark: SparkSession, sql: str, views: set[str], most: int = 50) -> DataFrame:
    """The rows of a checked query as JSON objects, at most `most`: what is shown to a reader."""
    check(spark, sql, views)
    from pyspark.sql import functions as F

    out = spark.sql(sql).limit(most)
    return out.select(F.to_json(F.struct("*")).alias("row"))
