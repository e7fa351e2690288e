"""Scans, filters, sorts, limits and exports of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factsheet.functions.measures import bucketize, safe_ratio
from factsheet.functions.text import matches_ignoring_case
from factsheet.operators import ordering
from factsheet.plans import risk
from factsheet.plans.registry import ORACLES, query
from factsheet.plans.tables import _order_regions, read_table
from factsheet.sources.publish import export, fresh_path


@query("scan_all", "SELECT * FROM orders")
def scan_all(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders")


@query("scan_columns", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def scan_columns(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")


@query("filter_eq", "SELECT * FROM part WHERE p_type = 'ECONOMY'")
def filter_eq(spark: SparkSession, folder: str) -> DataFrame:
    found = read_table(spark, folder, "part").filter(F.col("p_type") == "ECONOMY")
    return ordering.sort_rows(found, F.desc("p_size"), unique="p_partkey")


@query("filter_conj", "SELECT * FROM part WHERE p_type = 'ECONOMY' AND p_size > 25 AND p_retailprice > 950.0")
def filter_conj(spark: SparkSession, folder: str) -> DataFrame:
    wanted = (F.col("p_type") == "ECONOMY") & (F.col("p_size") > 25) & (F.col("p_retailprice") > 950.0)
    return ordering.sort_rows(read_table(spark, folder, "part").filter(wanted), F.desc("p_size"), unique="p_partkey")


@query(
    "filter_in",
    """SELECT o_orderkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'ASIA', 'EUROPE')""",
)
def filter_in(spark: SparkSession, folder: str) -> DataFrame:
    placed = _order_regions(spark, folder).filter(F.col("entity").isin("AFRICA", "ASIA", "EUROPE"))
    return placed.select("o_orderkey", F.col("entity").alias("r_name"))


@query("filter_like_ci", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'household'")
def filter_like_ci(spark: SparkSession, folder: str) -> DataFrame:
    people = read_table(spark, folder, "customer").filter(matches_ignoring_case("c_mktsegment", "household"))
    return people.select("c_custkey", "c_mktsegment")


@query(
    "ratio_pct",
    """SELECT l_orderkey, l_linenumber, l_tax / NULLIF(l_discount, 0) * 100 AS ratio_pct,
  l_extendedprice - l_extendedprice * l_discount AS net_price FROM lineitem""",
)
def ratio_pct(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (safe_ratio("l_tax", "l_discount") * 100).alias("ratio_pct"),
        (price - price * F.col("l_discount")).alias("net_price"),
    )


@query(
    "safe_ratio",
    """SELECT s_suppkey, CAST(COUNT(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O'), 0) AS ratio
FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey""",
)
def ratio_by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    counts = (
        read_table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("s_suppkey"))
        .agg(F.count_if(flag == "R").alias("part"), F.count_if((flag == "A") & (F.col("l_linestatus") == "O")).alias("whole"))
    )
    suppliers = read_table(spark, folder, "supplier").select("s_suppkey").join(counts, "s_suppkey", "left").fillna(0, ["part", "whole"])
    return suppliers.select("s_suppkey", safe_ratio(F.col("part").cast("double"), "whole").alias("ratio"))


@query(
    "bucketize",
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_band FROM part",
)
def size_band(spark: SparkSession, folder: str) -> DataFrame:
    band = bucketize("p_size", below=[(10, "small"), (30, "medium")], otherwise="large")
    return read_table(spark, folder, "part").select("p_partkey", band.alias("size_band"))


@query("sort_asc", "SELECT * FROM part ORDER BY p_size, p_partkey")
def sort_asc(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.sort_rows(read_table(spark, folder, "part"), "p_size", unique="p_partkey")


@query("sort_desc", "SELECT * FROM part ORDER BY p_size DESC, p_partkey")
def sort_desc(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.sort_rows(read_table(spark, folder, "part"), F.desc("p_size"), unique="p_partkey")


@query("sort_multi", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey")
def sort_multi(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ordering.sort_rows(orders, F.desc("o_orderstatus"), F.asc("o_totalprice"), unique="o_orderkey")


@query("sort_alias", "SELECT p_partkey, p_retailprice / NULLIF(p_size, 0) AS price_per_size FROM part ORDER BY price_per_size NULLS FIRST, p_partkey")
def sort_alias(spark: SparkSession, folder: str) -> DataFrame:
    priced = read_table(spark, folder, "part").select("p_partkey", safe_ratio("p_retailprice", "p_size").alias("price_per_size"))
    return ordering.sort_rows(priced, "price_per_size", unique="p_partkey")


@query("top_n", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def top_n(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.top_rows(read_table(spark, folder, "orders"), 1000, F.desc("o_totalprice"), unique="o_orderkey")


@query("export_results", ORACLES["combined_signal_rate"])
def export_results(spark: SparkSession, folder: str) -> DataFrame:
    """Write the combined-signal rates for use elsewhere and read the files back."""
    rates = risk.combined_signal_rate(spark, folder)
    path = export(rates, fresh_path(spark, "combined_signal_rate"), "csv", one_file=True)
    return spark.read.schema(rates.schema).option("header", True).csv(path)
