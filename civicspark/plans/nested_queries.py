"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators import nested
from civicspark.session import table


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return (
        table(spark, d, "meetings").select("meeting_id", "categories"),
        nested.parse_payloads(table(spark, d, "raw_meetings").select("meeting_id", "payload")).where("readable"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every item with an id under a category, over all rows and readable payloads; distinct."""
    cols = ["meeting_id", "category_id", "item_id"]
    typed, raw = (nested.items_table(x, ["meeting_id"]).where("item_id is not null").select(cols) for x in _sources(spark, d))
    return typed.union(raw).distinct()


def _all(spark: SparkSession, d: str, make: object, cols: list[str]) -> DataFrame:
    typed, raw = (make(x, ["meeting_id"]) for x in _sources(spark, d))
    return typed.withColumn("origin", F.lit("meetings")).unionByName(raw.withColumn("origin", F.lit("raw_meetings")), allowMissingColumns=True).select("origin", *cols)


def p3_categories(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d, nested.categories_table, ["meeting_id", "ord_1", "category_id", "category_order", "category_name"])


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d, nested.items_table, ["meeting_id", "ord_1", "ord_2", "category_id", "item_id", "parent_item_id", "item_order", "item_name"])


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d, nested.links_table, ["meeting_id", "ord_1", "ord_2", "ord_3", "category_id", "item_id", "link_order", "link_key", "href", "link_text", "filename"])


def p3_meeting_links(spark: SparkSession, d: str) -> DataFrame:
    """The typed table's links alone: the part that SQL can state too."""
    t = nested.links_table(table(spark, d, "meetings").select("meeting_id", "categories"), ["meeting_id"])
    return t.groupBy("meeting_id", "category_id", "item_id").agg(F.count("*").alias("n_links"), F.count("link_key").alias("n_keys"))


def p3_meeting_items(spark: SparkSession, d: str) -> DataFrame:
    t = nested.items_table(table(spark, d, "meetings").select("meeting_id", "categories"), ["meeting_id"])
    return t.select("meeting_id", "ord_1", "ord_2", "category_id", "item_id", "item_order", "item_name")


QUERIES = {f.__name__: f for f in (p3_found, p3_categories, p3_items, p3_links, p3_meeting_links, p3_meeting_items)}

SQL = {
    "p3_meeting_items": """
        WITH c AS (SELECT meeting_id, generate_subscripts(categories, 1) - 1 AS ord_1, unnest(categories) AS cat FROM meetings),
             i AS (SELECT meeting_id, ord_1, cat.category_id AS category_id, generate_subscripts(cat.items, 1) - 1 AS ord_2, unnest(cat.items) AS it FROM c)
        SELECT meeting_id, ord_1, ord_2, category_id, it.item_id AS item_id, it.item_order AS item_order, it.item_name AS item_name FROM i""",
    "p3_meeting_links": """
        WITH c AS (SELECT meeting_id, unnest(categories) AS cat FROM meetings),
             i AS (SELECT meeting_id, cat.category_id AS category_id, unnest(cat.items) AS it FROM c),
             l AS (SELECT meeting_id, category_id, it.item_id AS item_id, unnest(it.links) AS li FROM i)
        SELECT meeting_id, category_id, item_id, count(*) AS n_links, count(li.link_key) AS n_keys FROM l GROUP BY ALL""",
}
