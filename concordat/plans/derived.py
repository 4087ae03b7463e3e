"""Business documents derived from the order tables, for the registered queries.

Orders stand for invoices with their lines; what was ordered and what was received are
other cuts of the same lines. Positions are whole rows, because (order, line number)
repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.session import table

MONEY = "decimal(18,2)"
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, sku, description, quantity, unit_price (the extended price stands for it) and the rates."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"), F.struct(*LINE_ORDER).alias("pos"), F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("P-"), F.col("l_partkey"))).alias("sku"),
        F.concat(F.lit(" Part "), F.col("l_partkey")).alias("description"), F.col("l_quantity").cast(MONEY).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("unit_price"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"),
        F.col("l_discount").cast("decimal(6,2)").alias("discount"), F.col("l_tax").cast("decimal(6,2)").alias("tax"), F.to_date("l_shipdate").alias("shipdate"),
    )


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir).where("line >= 2")
    return x.withColumn("quantity", (F.col("quantity") + F.when(F.col("flag") == "R", 1).otherwise(0)).cast(MONEY))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir).where("line <= 5")
    return x.withColumn("unit_price", (F.col("unit_price") - F.when(F.col("flag") == "A", F.lit("5.00").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))).cast(MONEY))


def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where("line <= 4")


def headers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Invoice and order headers by order key; names, currencies and totals differ by rule."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(MONEY).alias("t"))
    n = F.col("o_custkey")
    invoice = o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("PO-"), F.col("o_orderkey") + F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(0)).alias("po_number"),
        F.when(n % 11 == 0, "usd").otherwise("EUR").alias("currency"), F.concat(F.lit("Supplier "), n % 7, F.lit(" GmbH")).alias("seller"),
        F.concat(F.lit("Customer "), n, F.when(n % 2 == 0, " S.A.").otherwise(" Ltd")).alias("buyer"), F.col("t").alias("total"),
    )
    order = o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("po-"), F.col("o_orderkey")).alias("po_number"), F.lit("EUR").alias("currency"),
        F.concat(F.lit("SUPPLIER "), n % 8).alias("seller"), F.concat(F.lit("customer "), n).alias("buyer"),
        (F.col("t") - F.when(F.col("o_orderkey") % 3 == 0, F.lit("0.01").cast(MONEY)).when(F.col("o_orderkey") % 3 == 1, F.lit("0.02").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))).cast(MONEY).alias("total"),
    )
    return invoice, order


#: The same tables for the oracle.
SQL = """
with li as (select l_orderkey id, l_linenumber line, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag flag,
  case when l_suppkey % 5 <> 0 then 'p-' || l_partkey end sku, 'part ' || l_partkey description,
  cast(l_quantity as decimal(18,2)) quantity, cast(l_extendedprice as decimal(18,2)) unit_price,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) pos from lineitem),
inv as (select id, pos, sku, description, cast(quantity + case when flag = 'R' then 1 else 0 end as decimal(18,2)) quantity, unit_price from li where line >= 2),
ord as (select id, pos, sku, description, quantity, cast(unit_price - case when flag = 'A' then 5.00 else 0 end as decimal(18,2)) unit_price from li where line <= 5),
rec as (select id, pos, sku, description, quantity, unit_price from li where line <= 4),
hi as (select o_orderkey id, 'PO-' || (o_orderkey + case when o_orderkey % 17 = 0 then 1 else 0 end) po_number, case when o_custkey % 11 = 0 then 'usd' else 'EUR' end currency,
  'supplier ' || (o_custkey % 7) seller, 'customer ' || o_custkey buyer, cast(o_totalprice as decimal(18,2)) total from orders),
ho as (select o_orderkey id, 'po-' || o_orderkey po_number, 'supplier ' || (o_custkey % 8) seller, 'customer ' || o_custkey buyer,
  cast(cast(o_totalprice as decimal(18,2)) - case o_orderkey % 3 when 0 then 0.01 when 1 then 0.02 else 0 end as decimal(18,2)) total from orders)
"""
