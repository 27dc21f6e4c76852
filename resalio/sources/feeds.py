"""Inputs: catalogs in CSV, raw sheets, listing feeds, dimensions, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.price import MONEY, parse_feed_price
from ..functions.text import item_id
from ..operators.ordering import numbered

RAW_ROWS = "catalog_id string, sheet_idx int, sheet string, row_idx int, cells array<string>"
DETAILS = "item_id string, d_sold bigint, d_condition string, d_listing_type string, d_seller_id bigint, d_free_shipping boolean, d_logistic_type string, d_category_id string, d_price decimal(12,2)"
FEES = "category_id string, price_from decimal(12,2), price_to decimal(12,2), fee_pct decimal(5,2)"
API_ITEM = "array<struct<id:string,title:string,price:decimal(18,4),sold_quantity:long,condition:string,listing_type_id:string,category_id:string,permalink:string,thumbnail:string,seller:struct<id:long>>>"
ACTOR_ITEM = "array<struct<eTituloProduto:string,SKU:string,novoPreco:string,zProdutoLink:string,imagemLink:string,produtoCategoryID:string>>"


def parse_api_listings(df: DataFrame) -> DataFrame:
    """S3: search results (query, json) as listings: an id, a title that isn't blank, a price above 0."""
    items = df.select("query", F.posexplode(F.from_json("json", API_ITEM)).alias("at", "i")).filter("coalesce(i.id, '') <> '' AND trim(coalesce(i.title, '')) <> '' AND i.price > 0")
    text = lambda c: F.coalesce(f"i.{c}", F.lit(""))
    return items.select(
        "query", (F.col("at") + 1).alias("position"), F.col("i.id").alias("item_id"), F.trim("i.title").alias("title"), F.bround("i.price", 2).cast(MONEY).alias("price"),
        F.coalesce("i.sold_quantity", F.lit(0)).alias("sold_quantity"), F.coalesce("i.seller.id", F.lit(0)).alias("seller_id"), text("condition").alias("condition"),
        text("listing_type_id").alias("listing_type"), text("category_id").alias("category_id"), text("permalink").alias("permalink"), text("thumbnail").alias("thumbnail"),
    )


def parse_actor_listings(df: DataFrame) -> DataFrame:
    """An actor's results (query, json) as listings; positions count all items, sales and sellers are unknown."""
    items = df.select("query", F.posexplode(F.from_json("json", ACTOR_ITEM)).alias("at", "i"))
    text = lambda c: F.trim(F.coalesce(f"i.{c}", F.lit("")))
    items = items.withColumns({"title": text("eTituloProduto"), "price": parse_feed_price(text("novoPreco")), "permalink": text("zProdutoLink")}).filter("title <> '' AND price > 0")
    return items.select(
        "query", (F.col("at") + 1).alias("position"), F.coalesce(F.nullif(text("SKU"), F.lit("")), item_id("permalink"), F.lit("")).alias("item_id"), "title", "price",
        F.lit(0).cast("long").alias("sold_quantity"), F.lit(0).cast("long").alias("seller_id"), F.lit("").alias("condition"), F.lit("").alias("listing_type"),
        text("produtoCategoryID").alias("category_id"), "permalink", text("imagemLink").alias("thumbnail"),
    )


def apply_name_batches(products: DataFrame, responses: DataFrame, size: int = 50) -> DataFrame:
    """Names from responses (catalog_id, batch, json array) put on products without one, by place in batches of so many.

    Products are numbered by product_id among those of their catalog without a name. Names that aren't text, are
    blank or missing leave null.
    """
    has = F.coalesce("normalized_name", F.lit("")) != ""
    number = F.col("__number") - 1
    df = numbered(products.withColumn("__has", has), ["catalog_id", "__has"], [F.col("product_id")], "__number")
    df = df.withColumns({"__batch": F.when(~F.col("__has"), F.floor(number / size)), "__at": (number % size).cast("int")}).drop("__number", "__has")
    names = responses.select(F.col("catalog_id"), F.col("batch").alias("__batch"), F.posexplode_outer(F.from_json("json", "array<string>")).alias("__at", "__name"))
    out = df.join(names, ["catalog_id", "__batch", "__at"], "left")
    return out.withColumn("normalized_name", F.when(has, F.col("normalized_name")).otherwise(F.nullif(F.trim("__name"), F.lit("")))).drop("__batch", "__at", "__name")
