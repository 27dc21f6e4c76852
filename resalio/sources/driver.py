"""The engine's tables from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.price import MONEY


#: What orders a product's lines.
LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: a brand is a catalog, the size stands for units per package."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("catalog_id"), F.concat("p_name", F.lit(" CX"), F.col("p_size").cast("string")).alias("raw_name"),
        F.lit(None).cast("string").alias("normalized_name"), F.col("p_type").alias("category"), F.col("p_retailprice").cast(MONEY).alias("cost"),
    )


def listings(spark: SparkSession, sf_dir: str, positions: bool = False) -> DataFrame:
    """Order lines as listings. Prices are whole cents, half up. position: what orders a product's listings."""
    cents = F.expr("(2 * cast(round(l_extendedprice * 100) AS bigint) + cast(l_quantity AS bigint)) div (2 * cast(l_quantity AS bigint))")
    df = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item_id"),
        (cents * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY).alias("price"), (F.col("l_quantity") * 1000).cast("long").alias("sold_quantity"), F.col("l_suppkey").alias("seller_id"),
        (F.col("l_returnflag") == "R").alias("free_shipping"), F.when(F.col("l_linestatus") == "O", 10 + F.round(F.col("l_discount") * 100)).cast("decimal(5,2)").alias("ml_fee_pct"),
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
    )
    if not positions:
        return df.drop(*LINE)
    return df.withColumn("position", F.struct("l_orderkey", "l_linenumber", "seller_id", *LINE[2:])).drop(*LINE)


#: Orders whose lines make one sheet: what bounds a sheet, however many orders there are.
ORDERS = 64


def sheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered within sheets of ORDERS orders: catalog_id, n from 1, and the line's columns."""
    line = read(spark, sf_dir, "lineitem").withColumn("catalog_id", F.floor(F.col("l_orderkey") / ORDERS).cast("string"))
    by = Window.partitionBy("catalog_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *LINE[2:])
    return line.withColumn("n", F.row_number().over(by))
