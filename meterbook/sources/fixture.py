"""A usage table derived from the driver's star-schema tables.

One row per line item, 25 string columns named like a usage export. It plants the dirty
cases the reports must handle: null and blank invoice numbers, null usage dates, null
subcategories, ``n/a`` quantities, null / blank / untrimmed tags, and customers, domains and
invoice numbers whose spelling differs in case from line to line of one invoice.

The joins are written dimension-first (customer with nation, then orders with customers).
Line items meet parts and suppliers before the orders: a filter on the meter or the unit then
cuts the rows before their widest shuffle. The joins leave the physical choice to Spark: small sides are broadcast by the
planner's size check (``autoBroadcastJoinThreshold`` and AQE's runtime statistics), large ones
are shuffled on their keys. Only the needed columns reach each scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S = T.StringType()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast(S)


def _dec_text(c, precision: int, scale: int) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast(T.DecimalType(precision, scale)).cast(S)


def billing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage table over the tables in ``sf_dir`` (all columns strings)."""
    lineitem = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast(T.DateType()).alias("l_shipdate"),
    )
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast(T.DateType()).alias("o_orderdate"), "o_orderpriority"
    )
    customer = _table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = _table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    customers = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    placed = orders.join(customers, orders.o_custkey == customers.c_custkey)
    rows = (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
        .join(placed, lineitem.l_orderkey == placed.o_orderkey)
    )

    ship_day = _text("l_shipdate")
    return rows.select(
        F.concat(_text("l_orderkey"), F.lit("-"), _text("l_linenumber"), F.lit("-"),
                 _text("l_partkey"), F.lit("-"), _text("l_suppkey")).alias("_row_id"),
        _text("s_suppkey").alias("PartnerId"),
        F.col("s_name").alias("PartnerName"),
        _text("c_custkey").alias("CustomerId"),
        F.when(F.col("l_linenumber") == 4, F.upper("c_name")).otherwise(F.col("c_name")).alias("CustomerName"),
        F.concat(F.when(F.col("l_linenumber") == 5, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")),
                 F.lit(".example.com")).alias("CustomerDomainName"),
        F.col("n_name").alias("CustomerCountry"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast(S))
        .when(F.col("o_orderkey") % 13 == 0, F.lit("  "))
        .otherwise(F.concat(F.when(F.col("l_linenumber") == 3, F.lit("inv-")).otherwise(F.lit("INV-")), _text("o_orderkey")))
        .alias("InvoiceNumber"),
        F.col("p_name").alias("ProductName"),
        F.when(F.col("l_linestatus") == "O", F.lit("new")).otherwise(F.lit("renew")).alias("ChargeType"),
        _text("o_orderdate").alias("ChargeStartDate"),
        ship_day.alias("ChargeEndDate"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast(S)).otherwise(ship_day).alias("UsageDate"),
        F.col("l_returnflag").alias("MeterType"),
        F.col("p_type").alias("MeterCategory"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None).cast(S)).otherwise(F.col("p_brand")).alias("MeterSubCategory"),
        F.col("p_name").alias("MeterName"),
        F.when(F.col("p_size") % 2 == 0, F.lit("1 Hour")).otherwise(F.lit("1 GB")).alias("Unit"),
        F.concat(F.lit("E"), _text("p_size")).alias("EntitlementId"),
        F.concat(F.lit("Plan "), _text("p_size")).alias("EntitlementDescription"),
        F.when(F.col("l_linenumber") == 1, F.lit(None).cast(S))
        .when(F.col("l_linenumber") == 2, F.lit("  "))
        .otherwise(F.concat(F.lit(" env="), F.col("o_orderpriority"))).alias("Tags"),
        F.when(F.col("l_partkey") % 19 == 0, F.lit("n/a"))
        .otherwise(_dec_text("l_quantity", 18, 2)).alias("Quantity"),
        _dec_text("p_retailprice", 18, 2).alias("UnitPrice"),
        _dec_text(F.col("l_extendedprice") * (1 - F.col("l_discount")), 18, 4).alias("PricingPreTaxTotal"),
        _dec_text("l_extendedprice", 18, 2).alias("BillingPreTaxTotal"),
    )


# The same table as SQL text for an independent engine; {S} is the string type name.
BILLING_VIEW_SQL = """
SELECT concat(CAST(l_orderkey AS {S}), '-', CAST(l_linenumber AS {S}), '-', CAST(l_partkey AS {S}), '-', CAST(l_suppkey AS {S})) AS _row_id,
  CAST(s_suppkey AS {S}) AS PartnerId, s_name AS PartnerName, CAST(c_custkey AS {S}) AS CustomerId,
  CASE WHEN l_linenumber = 4 THEN upper(c_name) ELSE c_name END AS CustomerName,
  concat(CASE WHEN l_linenumber = 5 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END, '.example.com') AS CustomerDomainName,
  n_name AS CustomerCountry,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '  '
       ELSE concat(CASE WHEN l_linenumber = 3 THEN 'inv-' ELSE 'INV-' END, CAST(o_orderkey AS {S})) END AS InvoiceNumber,
  p_name AS ProductName, CASE WHEN l_linestatus = 'O' THEN 'new' ELSE 'renew' END AS ChargeType,
  CAST(CAST(o_orderdate AS DATE) AS {S}) AS ChargeStartDate, CAST(CAST(l_shipdate AS DATE) AS {S}) AS ChargeEndDate,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS {S}) END AS UsageDate,
  l_returnflag AS MeterType, p_type AS MeterCategory,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS MeterSubCategory,
  p_name AS MeterName, CASE WHEN p_size % 2 = 0 THEN '1 Hour' ELSE '1 GB' END AS Unit,
  concat('E', CAST(p_size AS {S})) AS EntitlementId, concat('Plan ', CAST(p_size AS {S})) AS EntitlementDescription,
  CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN '  '
       ELSE concat(' env=', o_orderpriority) END AS Tags,
  CASE WHEN l_partkey % 19 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS {S}) END AS Quantity,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS {S}) AS UnitPrice,
  CAST(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS {S}) AS PricingPreTaxTotal,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {S}) AS BillingPreTaxTotal
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey
"""


def billing_view_sql(string_type: str = "VARCHAR") -> str:
    return BILLING_VIEW_SQL.replace("{S}", string_type)
