"""One lookup per entity, joined back to every row that names it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.session import table


def first_per_entity(rows: DataFrame, key: str | Column, order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order; blank and null keys are left out."""
    key = F.col(key) if isinstance(key, str) else key
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.where(F.trim(F.coalesce(key.cast("string"), F.lit(""))) != "").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def join_entities(rows: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """Every row gets the facts of its entity; rows without one keep nulls. facts: one row for each key."""
    return rows.join(facts, on, "left")


def _entity_first(spark, sf_dir) -> DataFrame:
    orders = first_per_entity(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderkey"])
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = join_entities(join_entities(customers, orders, "o_custkey"), nations, "c_nationkey")
    listed = F.col("o_orderkey").isNotNull()
    return joined.select(
        F.col("o_custkey").alias("custkey"),
        F.col("c_name").alias("company"),
        F.col("n_name").alias("country"),
        F.col("o_orderkey").alias("first_order"),
        F.col("o_totalprice").alias("first_price"),
        F.when(listed, "orders").otherwise("").alias("source"),
        F.when(listed, "High").otherwise("").alias("confidence"),
    )


QUERIES = {"entity_first": _entity_first}
ORACLE = {
    "entity_first": """
        WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
        SELECT c_custkey AS custkey, c_name AS company, n_name AS country, o_orderkey AS first_order, o_totalprice AS first_price,
               CASE WHEN o_orderkey IS NULL THEN '' ELSE 'orders' END AS source, CASE WHEN o_orderkey IS NULL THEN '' ELSE 'High' END AS confidence
        FROM customer LEFT JOIN f ON o_custkey = c_custkey AND rn = 1 LEFT JOIN nation ON n_nationkey = c_nationkey"""
}
