"""Repair of the property sales table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factsheet.functions import text
from factsheet.functions.dates import parse_day_first
from factsheet.functions.measures import MONEY
from factsheet.operators import duplicates, profiling, repair
from factsheet.plans.registry import query
from factsheet.plans.tables import PROPERTIES_SQL, properties, read_table


@query("filter_null", f"WITH {PROPERTIES_SQL} SELECT unique_id, parcel_id FROM properties WHERE property_address IS NULL")
def filter_null(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.null_rows(properties(spark, folder), "property_address").select("unique_id", "parcel_id")


@query(
    "self_join_fill_preview",
    f"""WITH {PROPERTIES_SQL}
SELECT a.parcel_id, b.property_address AS sibling_value, COUNT(*) AS pairs
FROM properties a JOIN properties b ON a.parcel_id = b.parcel_id AND a.unique_id <> b.unique_id
WHERE a.property_address IS NULL GROUP BY a.parcel_id, b.property_address""",
)
def self_join_fill_preview(spark: SparkSession, folder: str) -> DataFrame:
    return repair.fill_preview(properties(spark, folder), "parcel_id", "property_address")


FILLED_SQL = f"""{PROPERTIES_SQL},
donors AS (SELECT parcel_id, arg_min(property_address, unique_id) AS donor FROM properties WHERE property_address IS NOT NULL GROUP BY parcel_id),
filled AS (SELECT p.* REPLACE (COALESCE(property_address, donor) AS property_address) FROM properties p LEFT JOIN donors USING (parcel_id))"""


@query("fill_from_sibling", f"WITH {FILLED_SQL} SELECT unique_id, parcel_id, property_address FROM filled")
def fill_from_sibling(spark: SparkSession, folder: str) -> DataFrame:
    sales = properties(spark, folder).select("unique_id", "parcel_id", "property_address")
    return repair.fill_from_sibling(sales, "parcel_id", "property_address", "unique_id")


@query(
    "split_address",
    f"""WITH {PROPERTIES_SQL}
SELECT unique_id,
  CASE WHEN strpos(property_address, ',') > 0 THEN substring(property_address, 1, strpos(property_address, ',') - 1) END AS property_address_street,
  substring(property_address, 1, strpos(property_address, ',') + 1) AS property_address_through,
  substring(property_address, strpos(property_address, ',') + 1) AS property_address_city,
  CAST(length(rtrim(property_address)) AS INTEGER) AS property_address_length
FROM properties""",
)
def split_address(spark: SparkSession, folder: str) -> DataFrame:
    sales = properties(spark, folder).select("unique_id", "property_address")
    return repair.split_address(sales, "property_address").drop("property_address")


@query(
    "split_from_right",
    """WITH hosts AS (SELECT page_id, string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.') AS p FROM pages)
SELECT page_id, CASE WHEN len(p) <= 4 AND len(p) >= 3 THEN p[-3] END AS site, CASE WHEN len(p) <= 4 THEN p[-2] END AS domain,
       CASE WHEN len(p) <= 4 THEN p[-1] END AS top FROM hosts""",
)
def split_from_right(spark: SparkSession, folder: str) -> DataFrame:
    hosts = read_table(spark, folder, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"))
    return repair.split_from_right(hosts, "host", ("site", "domain", "top")).drop("host")


@query(
    "value_counts",
    f"WITH {PROPERTIES_SQL} SELECT property_address, COUNT(property_address) AS n FROM properties GROUP BY property_address",
)
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.value_counts(properties(spark, folder), "property_address")


@query(
    "recode_column",
    f"""WITH {PROPERTIES_SQL}
SELECT unique_id, CASE sold_as_vacant WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' ELSE sold_as_vacant END AS sold_as_vacant FROM properties""",
)
def recode_column(spark: SparkSession, folder: str) -> DataFrame:
    sales = properties(spark, folder).select("unique_id", "sold_as_vacant")
    return repair.recode(sales, "sold_as_vacant", {"Y": "Yes", "N": "No"})


# Some addresses are NULL, which groups like a value.
KEYS = ["parcel_id", "property_address", "sold_as_vacant", "tax_district", "sale_year"]
NUMBERED_SQL = f"""{PROPERTIES_SQL},
sales AS (SELECT unique_id, parcel_id, property_address, sold_as_vacant, tax_district, CAST(EXTRACT(YEAR FROM sale_date) AS INTEGER) AS sale_year FROM properties),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {", ".join(KEYS)} ORDER BY unique_id) AS row_num FROM sales)"""


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    return properties(spark, folder).withColumn("sale_year", F.year("sale_date")).select("unique_id", *KEYS)


@query("dedupe_flag", f"WITH {NUMBERED_SQL} SELECT * FROM numbered WHERE row_num > 1")
def dedupe_flag(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.later_copies(_sales(spark, folder), KEYS, "unique_id")


@query("dedupe_keep", f"WITH {NUMBERED_SQL} SELECT * EXCLUDE (row_num) FROM numbered WHERE row_num = 1")
def dedupe_keep(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.first_copies(_sales(spark, folder), KEYS, "unique_id")


@query("to_date_column", "SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS sale_date_converted FROM orders")
def to_date_column(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return orders.withColumn("sale_date_converted", F.col("o_orderdate").cast("date"))


@query(
    "add_column",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS sale_date_converted,
  CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS split_city FROM orders""",
)
def add_column(spark: SparkSession, folder: str) -> DataFrame:
    """Columns are added without values, then set on the rows a condition picks."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    added = repair.add_columns(orders, {"sale_date_converted": "date", "split_city": "string"})
    pending = F.col("o_orderstatus") == "P"
    updated = added.withColumns(
        {
            "sale_date_converted": F.when(pending, F.col("sale_date_converted")).otherwise(F.col("o_orderdate").cast("date")),
            "split_city": F.when(pending, F.col("o_orderpriority")).otherwise(F.col("split_city")),
        }
    )
    return repair.drop_columns(updated, "o_orderstatus", "o_orderdate", "o_orderpriority")


@query("drop_columns", "SELECT * EXCLUDE (o_orderpriority, o_orderdate, o_totalprice) FROM orders")
def drop_columns(spark: SparkSession, folder: str) -> DataFrame:
    several = repair.drop_columns(read_table(spark, folder, "orders"), "o_orderpriority", "o_totalprice")
    return repair.drop_columns(several, "o_orderdate")


DIRTY_BRAND_SQL = "CASE WHEN p_size % 10 = 0 THEN p_brand WHEN p_size % 10 = 1 THEN ' ' ELSE replace(p_brand, 'Brand#', '') END"


@query(
    "repair_types",
    f"""WITH raw AS (SELECT p_partkey, p_size, p_retailprice, {DIRTY_BRAND_SQL} AS brand, CAST(p_size AS VARCHAR) AS size FROM part)
SELECT p_partkey, TRY_CAST(NULLIF(trim(brand), '') AS INTEGER) AS brand, CAST(size AS INTEGER) AS size,
  CASE WHEN p_size % 7 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END AS price,
  CASE WHEN p_size % 9 <> 0 THEN CAST(DATE '2024-01-01' + p_size AS DATE) END AS listed,
  array_to_string(list_filter([CASE WHEN trim(brand) <> '' AND TRY_CAST(brand AS INTEGER) IS NULL THEN 'brand' END,
    CASE WHEN p_size % 7 = 0 THEN 'price' END, CASE WHEN p_size % 9 = 0 THEN 'listed' END], lambda x: x IS NOT NULL), ',') AS failed_columns
FROM raw""",
)
def repair_types(spark: SparkSession, folder: str) -> DataFrame:
    digits = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    size, day = F.col("p_size"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    raw = read_table(spark, folder, "part").select(
        "p_partkey",
        F.when(size % 10 == 0, F.col("p_brand")).when(size % 10 == 1, " ").otherwise(digits).alias("brand"),
        size.cast("string").alias("size"),
        F.when(size % 7 == 0, "n/a").otherwise(F.format_number("p_retailprice", 2)).alias("price"),
        F.when(size % 9 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy")).alias("listed"),
    )
    repaired = repair.repair_types(raw, {"brand": "int", "size": "int", "price": text.clean_number, "listed": parse_day_first})
    return repaired.withColumn("failed_columns", F.array_join("failed_columns", ","))


@query(
    "column_types",
    """SELECT 'c_custkey' AS column_name, 'bigint' AS data_type, COUNT(c_custkey) AS non_null FROM customer
UNION ALL SELECT 'c_name', 'string', COUNT(c_name) FROM customer
UNION ALL SELECT 'c_nationkey', 'int', COUNT(c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', 'double', COUNT(c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', COUNT(c_mktsegment) FROM customer""",
)
def column_types(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.column_types(read_table(spark, folder, "customer"))


@query(
    "try_cast_all",
    """SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS as_bigint, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS as_float,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS as_decimal, CAST(o_orderdate AS DATE) AS as_date,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS mixed FROM orders""",
)
def try_cast_all(spark: SparkSession, folder: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    price = F.col("o_totalprice").cast(MONEY).cast("string")
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        text.read_as(key.cast("string"), "bigint").alias("as_bigint"),
        price.try_cast("double").alias("as_float"),
        text.read_as(price, MONEY).alias("as_decimal"),
        F.date_format("o_orderdate", "yyyy-MM-dd").try_cast("date").alias("as_date"),
        text.read_as(F.when(key % 3 == 0, key.cast("string")).otherwise(status), "bigint").alias("mixed"),
    )


@query(
    "strict_cast",
    "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS as_float FROM orders",
)
def strict_cast(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice").cast(MONEY).cast("string")
    return read_table(spark, folder, "orders").select("o_orderkey", price.cast("double").alias("as_float"))


@query(
    "parse_dmy_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders",
)
def parse_dmy_date(spark: SparkSession, folder: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = F.when(F.col("o_orderkey") % 10 == 0, iso).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return read_table(spark, folder, "orders").select("o_orderkey", parse_day_first(written).alias("parsed"))


@query(
    "clean_number",
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM lineitem",
)
def clean_number(spark: SparkSession, folder: str) -> DataFrame:
    written = F.concat(F.lit(" "), F.format_number("l_extendedprice", 2), F.lit(" %"))
    return read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", text.clean_number(written).alias("price"))


@query(
    "coalesce_fill",
    """SELECT o_orderkey, COALESCE(NULLIF(o_orderpriority, '4-NOT SPECIFIED'), o_orderstatus) AS priority,
  COALESCE(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0) AS filled_price FROM orders""",
)
def coalesce_fill(spark: SparkSession, folder: str) -> DataFrame:
    filled = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.coalesce(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")), "o_orderstatus").alias("priority"),
        F.coalesce(filled, F.lit(0.0)).alias("filled_price"),
    )


@query(
    "clean_housing_table",
    f"""WITH {FILLED_SQL},
parts AS (SELECT *, string_split(owner_address, '.') AS o FROM filled)
SELECT unique_id, parcel_id, CAST(sale_price AS DOUBLE) AS sale_price,
  CASE sold_as_vacant WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' ELSE sold_as_vacant END AS sold_as_vacant,
  CAST(sale_date AS DATE) AS sale_date_converted,
  CASE WHEN strpos(property_address, ',') > 0 THEN substring(property_address, 1, strpos(property_address, ',') - 1) END AS property_split_address,
  substring(property_address, strpos(property_address, ',') + 1) AS property_split_city,
  CASE WHEN len(o) >= 3 THEN o[-3] END AS owner_split_address, CASE WHEN len(o) >= 2 THEN o[-2] END AS owner_split_city,
  o[-1] AS owner_split_state
FROM parts""",
)
def clean_housing_table(spark: SparkSession, folder: str) -> DataFrame:
    return repair.clean_property_table(properties(spark, folder))
