"""The core's data model over the sample tables, in Spark and in DuckDB SQL.

A finding is an event: its channel and kind are the event's type, its file the
user, its run the day. Actions of a session are a user's events in order. A
kill is a part (mutant) with a supplier (test). The module graph has an edge
from a customer's nation to the nation of a supplier that serves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualitylens.session import table


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, channel, file, severity, confidence, run, ts, value."""
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "blocking").when(F.col("event_type") == "purchase", "warning").otherwise("informational")
    return e.select(
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("channel"),
        F.col("user_id").cast("string").alias("file"),
        severity.alias("severity"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        F.col("ts").cast("date").cast("string").alias("run"),
        "ts",
        "value",
    )


FINDINGS = """f as (select event_id as ord, event_type as channel, cast(user_id as varchar) as file,
  case event_type when 'error' then 'blocking' when 'purchase' then 'warning' else 'informational' end as severity,
  least(value / 500, 1.0) as confidence, cast(cast(ts as date) as varchar) as run, ts, value from events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: customer's nation to supplier's nation, distinct."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("dst"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("src", "dst").distinct()


EDGES = """g as (select distinct c_nationkey as src, s_nationkey as dst from orders join customer on o_custkey = c_custkey
  join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: parts that follow each other in an order, distinct. The edges
    grow with the orders; the graph has cycles."""
    li = table(spark, sf_dir, "lineitem")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    b = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()


PARTS = """g as (select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b
  on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber where a.l_partkey <> b.l_partkey)"""


def first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: the first and the second part of an order, distinct. Some six
    edges a part at every size, with cycles of all lengths."""
    li = table(spark, sf_dir, "lineitem")
    a = li.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src"))
    b = li.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("src <> dst").select("src", "dst").distinct()


FIRST = """g as (select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b
  on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber = 2 where a.l_partkey <> b.l_partkey)"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: what each region, nation, customer and order is made of, down
    to parts. Acyclic as it is; the edges grow with the tables."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    e = t("nation").select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
    e = e.union(t("customer").select(node("n", "c_nationkey"), node("c", "c_custkey")))
    e = e.union(t("orders").select(node("c", "o_custkey"), node("o", "o_orderkey")))
    return e.union(t("lineitem").select(node("o", "l_orderkey"), node("p", "l_partkey"))).distinct()


HIERARCHY = """g as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union select 'n' || c_nationkey, 'c' || c_custkey from customer
  union select 'c' || o_custkey, 'o' || o_orderkey from orders union select 'o' || l_orderkey, 'p' || l_partkey from lineitem)"""


def kills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mutant, test: parts and the suppliers that shipped them, distinct."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("mutant"), F.col("l_suppkey").alias("test")).distinct()


KILLS = "k as (select distinct l_partkey as mutant, l_suppkey as test from lineitem)"
