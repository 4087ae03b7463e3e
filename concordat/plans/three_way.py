"""Purchase order, goods receipt and invoice, derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concordat.session import table

MONEY = "decimal(18,2)"
TOLERANCE = "0.01"


def three_way_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each invoice line against what was ordered and what was received.

    Orders and receipts are reduced to one row per part before the join, so both joins
    have unique right sides; the sizes decide between broadcast and sort-merge.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").cast(MONEY).alias("ext")
    )
    po = (
        li.where("l_linenumber <= 3").groupBy("l_partkey")
        .agg(F.max("l_quantity").alias("po_qty"), F.min("ext").alias("po_ext"))
    )
    received = li.where("l_linenumber between 3 and 6").groupBy("l_partkey").agg(F.max("l_quantity").alias("wb_qty"))
    invoice = li.where("l_linenumber >= 5")
    tol = F.lit(TOLERANCE).cast(MONEY)
    return (
        invoice.join(received, "l_partkey", "left").join(po, "l_partkey", "left")
        .select(
            "l_orderkey", "l_partkey",
            F.when(F.col("wb_qty").isNull(), "not_received")
            .when((F.col("l_quantity") > F.col("wb_qty")) & (F.abs(F.col("l_quantity") - F.col("wb_qty")) > 0.01), "over_received")
            .otherwise("ok").alias("fulfilment"),
            F.when(F.col("po_ext").isNull(), "unordered")
            .when((F.col("ext") > F.col("po_ext")) & (F.abs(F.col("ext") - F.col("po_ext")) > tol), "price_variance")
            .otherwise("ok").alias("pricing"),
        )
    )


QUERIES = {"three_way_match": three_way_match}
ORACLE = {
    "three_way_match": """
with po as (select l_partkey k, max(l_quantity) qty, min(cast(l_extendedprice as decimal(18,2))) ext
            from lineitem where l_linenumber <= 3 group by 1),
     wb as (select l_partkey k, max(l_quantity) qty from lineitem where l_linenumber between 3 and 6 group by 1),
     i as (select l_orderkey, l_partkey, l_quantity q, cast(l_extendedprice as decimal(18,2)) ext
           from lineitem where l_linenumber >= 5)
select i.l_orderkey, i.l_partkey,
  case when wb.k is null then 'not_received' when i.q > wb.qty and abs(i.q - wb.qty) > 0.01 then 'over_received' else 'ok' end fulfilment,
  case when po.k is null then 'unordered' when i.ext > po.ext and abs(i.ext - po.ext) > 0.01 then 'price_variance' else 'ok' end pricing
from i left join wb on i.l_partkey = wb.k left join po on i.l_partkey = po.k""",
}
