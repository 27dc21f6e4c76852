"""Every registered query by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import price as P
from .functions import text as T
from .operators import finance, market, matching, reports, rows
from .plans import catalogs
from .queries import feeds, pairing, runs, sheets
from .sources import driver, sinks
from .sources.shared import materialize, new_folder
from .sources.tables import KeyedTable

FLAGSHIP = "opportunities"
Query = Callable[[SparkSession, str], DataFrame]


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison across engines."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def analysis(spark: SparkSession, d: str, positions: bool = False) -> catalogs.Analysis:
    return catalogs.analyze(driver.products(spark, d), driver.listings(spark, d, positions))


def market_of(spark: SparkSession, d: str) -> DataFrame:
    return market.market_analysis(driver.listings(spark, d))


def finance_of(spark: SparkSession, d: str) -> DataFrame:
    return finance.analyze(driver.products(spark, d), market_of(spark, d))


def scores_of(spark: SparkSession, d: str) -> DataFrame:
    return analysis(spark, d).scores


MARKET = ["product_id", "avg_price", "min_price", "max_price", "total_sellers", "total_listings_found", "avg_sold_quantity", "total_sold_quantity", "avg_ml_fee_pct", "free_shipping_pct"]
OPPORTUNITY = ["product_id", "catalog_id", "raw_name", "final_score", "rank_position", "recommendation", "avg_price", "gross_margin_pct", "net_margin_pct", "is_viable", "explanation"]


def whole(a: catalogs.Analysis, **chosen) -> DataFrame:
    """Q1, Q2."""
    own = ["product_id", "catalog_id", "final_score", "rank_position", "recommendation", "explanation", "demand_score", "margin_score", "competition_score", "confidence_score"]
    return reports.opportunities(a.products, a.scores.select(*own), a.market, a.finance, **chosen)


def with_listings(spark: SparkSession, d: str) -> DataFrame:
    a = analysis(spark, d, positions=True)
    df = whole(a, listings=a.listings)
    top = F.transform("listings", lambda s: s.item_id)
    return df.select("product_id", "rank_position", F.size("listings").cast("long").alias("n_listings"), F.array_join(top, ",").alias("item_ids"))


def enrich_capped(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for item details: of the first 20 listings of a product, units sold come from there."""
    lines = driver.read(spark, d, "lineitem")
    details = lines.filter("l_linenumber % 2 = 1").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item_id"), (F.col("l_quantity") * 7).cast("long").alias("d_sold"), F.lit("new").alias("d_condition"), F.lit("gold").alias("d_listing_type"), F.col("l_suppkey").alias("d_seller_id"), F.lit(True).alias("d_free_shipping"), F.lit("fulfillment").alias("d_logistic_type"), F.lit("c1").alias("d_category_id"))
    details = details.groupBy("item_id").agg(*[F.max(c).alias(c) for c in details.columns[1:]])
    given = driver.listings(spark, d, True).withColumns({c: F.lit("") for c in ("condition", "listing_type", "category_id", "logistic_type")})
    return market.enrich(given, details).select("product_id", "item_id", "seller_id", "sold_quantity", "condition", "free_shipping", "category_id")


def top_listings(spark: SparkSession, d: str) -> DataFrame:
    return doubles(market.top_listings(driver.listings(spark, d, True)).select("product_id", "rank_position", "item_id", "price", "sold_quantity", "seller_id"))


def price_parse(spark: SparkSession, d: str) -> DataFrame:
    """Line prices written in five styles, read again."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole_part, rest = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    thousands, under = F.floor(cents / 100000).cast("string"), F.lpad((F.floor(cents / 100) % 1000).cast("string"), 3, "0")
    style = F.col("l_orderkey") % 5
    raw = F.when(style == 0, F.concat(F.lit("R$ "), whole_part, F.lit(","), rest)).when(style == 1, F.concat(whole_part, F.lit("."), rest)).when(style == 2, F.concat(F.lit("R$"), thousands, F.lit("."), under, F.lit(","), rest)).when(style == 3, whole_part).otherwise(F.concat(thousands, F.lit("."), under))
    return driver.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw")).select("l_orderkey", "l_linenumber", P.parse_price("raw").cast("double").alias("price"))


def names(spark: SparkSession, d: str) -> DataFrame:
    return driver.products(spark, d).select("product_id", "raw_name", T.norm_match("raw_name").alias("norm"), F.array_join(T.tokens("raw_name"), " ").alias("tokens"), T.search_query("raw_name").alias("search_query"), P.units_per_package("raw_name").alias("units"), P.unit_cost("cost", "raw_name").cast("double").alias("unit_cost"))


def norm_documents(spark: SparkSession, d: str) -> DataFrame:
    return driver.read(spark, d, "documents").select("doc_id", T.norm_match("text").alias("norm"), T.norm_header("text").alias("header"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Part names against names of the parts bought with them most: each line's part and the next line's of its order."""
    part = driver.read(spark, d, "part")
    line = driver.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("other"))
    both = line.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("product_id"), "other").distinct()
    a = matching.prepare(part.select(F.col("p_partkey").alias("product_id"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("ml 110v")).alias("name")), "name", "catalog")
    b = matching.prepare(part.select(F.col("p_partkey").alias("other"), F.concat("p_name", F.lit(" Kit "), F.col("p_size").cast("string"), F.lit("ml "), F.when(F.col("p_size") % 3 == 0, "220v").when(F.col("p_size") % 3 == 1, "bivolt").otherwise("p")).alias("title")), "title", "listing")
    scored = matching.match_score(both.join(a, "product_id").join(b, "other"))
    return scored.select("product_id", "other", "match_score", F.bround("match_base", 6).alias("match_base"), F.array_join("match_reasons", ",").alias("reasons"))


def token_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts with their types against names with their brands, each name once: pairs of a similarity of a half or more."""
    part = driver.read(spark, d, "part")
    a = matching.prepare(part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("product_id")).withColumn("name", F.concat_ws(" ", "p_name", "p_type")), "name", "catalog").select("product_id", "catalog_tokens")
    b = matching.prepare(part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("item_id")).withColumn("name", F.concat_ws(" ", "p_name", "p_brand")), "name", "listing").select("item_id", "listing_tokens")
    found = matching.candidates_by_tokens(a, b).join(a, "product_id").join(b, "item_id")
    score = matching.weighted_jaccard(F.col("catalog_tokens"), F.col("listing_tokens"))
    return found.select("product_id", "item_id", F.bround(score, 6).alias("jaccard")).filter("jaccard >= 0.5")


def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of some orders as a sheet: a category now and then, blank rows, SKUs that come again."""
    return driver.sheet_lines(spark, d).select(
        "catalog_id", F.lit("s").alias("sheet"), F.col("n").alias("row_idx"), F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).alias("category"),
        (F.col("l_partkey") % 50).cast("string").alias("sku"), F.when(F.col("l_quantity") > 25, F.array(F.lit(" "))).otherwise(F.array(F.col("l_partkey").cast("string"))).alias("cells"),
    )


def category_fill(spark: SparkSession, d: str) -> DataFrame:
    return rows.fill_category(sheet_rows(spark, d)).select("catalog_id", "row_idx", "category")


def dup_sku(spark: SparkSession, d: str) -> DataFrame:
    return rows.flag_dup_sku(sheet_rows(spark, d)).groupBy("catalog_id").agg(F.count("*").alias("n_rows"), F.count_if("is_dup_sku").alias("duplicates"))


def blank_run_cut(spark: SparkSession, d: str) -> DataFrame:
    return rows.cut_after_blank_run(sheet_rows(spark, d), 3).groupBy("catalog_id").agg(F.count("*").alias("n_rows"), F.max("row_idx").alias("last_row"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """T15 and P5 on the addresses of pages (page_titles has what their html holds)."""
    return driver.read(spark, d, "pages").select("page_id", T.query_slug("url").alias("slug"), P.parse_sold("url").alias("sold"))


def pending_products(spark: SparkSession, d: str) -> DataFrame:
    some = market_of(spark, d).filter("total_listings_found > 30")
    return market.pending(driver.products(spark, d), some).select("product_id", "catalog_id")


def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Market rows, those of over 30 listings with another price, and new rows beside them."""
    m = materialize(market_of(spark, d).select("product_id", "avg_price", "total_listings_found"), "market")
    new = m.filter("total_listings_found > 30").withColumn("avg_price", F.lit(0).cast(P.MONEY))
    new = new.unionByName(m.filter("total_listings_found <= 20").withColumn("product_id", -1 - F.col("product_id")))
    return doubles(sinks.upsert(m, new).drop("total_listings_found"))


def replace_children(spark: SparkSession, d: str) -> DataFrame:
    top = market.top_listings(driver.listings(spark, d, True)).select("product_id", "rank_position", "item_id")
    new = top.filter("product_id % 3 = 0 AND rank_position = 1").withColumn("item_id", F.lit("new"))
    return sinks.replace_children(top, new)


def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """S8 on disk: the same change of a table of buckets, in place; only the buckets of the updates are written again."""
    m = materialize(market_of(spark, d).select("product_id", "avg_price", "total_listings_found"), "market")
    table = KeyedTable(spark, new_folder(spark, "keyed"), buckets=16).create(m)
    new = m.filter("total_listings_found > 30").withColumn("avg_price", F.lit(0).cast(P.MONEY))
    table.upsert(new.unionByName(m.filter("total_listings_found <= 20").withColumn("product_id", -1 - F.col("product_id"))))
    return doubles(table.read().drop("total_listings_found"))


def keyed_children(spark: SparkSession, d: str) -> DataFrame:
    """S9 and S11 on disk: first listings of some products are replaced, those of others go."""
    top = materialize(market.top_listings(driver.listings(spark, d, True)).select("product_id", "rank_position", "item_id"), "top")
    table = KeyedTable(spark, new_folder(spark, "keyed"), buckets=16).create(top)
    table.replace_children(top.filter("product_id % 3 = 0 AND rank_position = 1").withColumn("item_id", F.lit("new")))
    table.delete(top.filter("product_id % 7 = 1"))
    return table.read()


def coverage(spark: SparkSession, d: str) -> DataFrame:
    a = analysis(spark, d)
    return reports.pipeline_coverage(a.products, a.market.filter("total_sellers > 0"), a.finance.filter("is_viable"), a.scores.filter("final_score >= 75"))


def filtered(f: reports.OpportunityFilter) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        a = analysis(spark, d)
        keep = ["product_id", "catalog_id", "final_score", "recommendation", "rank_position", "is_viable", "gross_margin_pct", "listings_above_threshold"]
        return doubles(reports.opportunity_filter(a.scores, a.market, a.finance, f).select(*keep))

    return run


FINANCE = ["product_id", "cost", "avg_market_price", "ml_fee", "gross_margin", "gross_margin_pct", "break_even_price", "price_safety_margin_pct", "net_margin", "net_margin_pct", "is_viable", "min_price_for_target_margin", "tax_cost", "fulfillment_cost"]
SCORES = ["product_id", "catalog_id", "demand_score", "margin_score", "competition_score", "confidence_score", "final_score", "recommendation", "rank_position"]


def queries() -> dict[str, Query]:
    return {
        "opportunities": lambda s, d: doubles(whole(analysis(s, d)).select(*OPPORTUNITY)),
        "opportunities_excellent": lambda s, d: doubles(whole(analysis(s, d), recommendation="EXCELENTE", min_score=60).select(*OPPORTUNITY)),
        "opportunity_listings": with_listings,
        "opportunity_filter": filtered(reports.OpportunityFilter()),
        "opportunity_filter_good": filtered(reports.OpportunityFilter.good_and_above(10.0)),
        "market_competitive_price": lambda s, d: doubles(market.competitive_price(driver.listings(s, d))),
        "market_analysis": lambda s, d: doubles(market_of(s, d).select(*MARKET)),
        "sales_filter": lambda s, d: market.sales_filter(driver.listings(s, d), 45000).groupBy("product_id").agg(F.count("*").alias("n"), F.sum("sold_quantity").alias("sold")),
        "top_listings": top_listings,
        "enrich_capped": enrich_capped,
        "pending_products": pending_products,
        "finance": lambda s, d: doubles(finance_of(s, d).select(*FINANCE)),
        "finance_summary": lambda s, d: finance_of(s, d).select("product_id", finance.finance_summary().alias("summary")),
        "scores": lambda s, d: doubles(scores_of(s, d).select(*SCORES)),
        "explanation": lambda s, d: scores_of(s, d).select("product_id", "explanation"),
        "recommendation_counts": lambda s, d: reports.recommendation_counts(scores_of(s, d)),
        "pipeline_coverage": coverage,
        "dashboard_view": lambda s, d: doubles(reports.dashboard_view(whole(analysis(s, d))).select("product_id", "margin_band", "mostly_free_shipping", "effective_price")),
        "price_parse": price_parse,
        "names": names,
        "norm_documents": norm_documents,
        "match_score": pairs,
        "token_candidates": token_candidates,
        "category_fill": category_fill,
        "dup_sku": dup_sku,
        "blank_run_cut": blank_run_cut,
        "page_slugs": pages,
        "upsert": upsert,
        "replace_children": replace_children,
        "keyed_upsert": keyed_upsert,
        "keyed_children": keyed_children,
    } | sheets.QUERIES | feeds.QUERIES | pairing.QUERIES | runs.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.sql() | sheets.sql() | feeds.sql() | pairing.sql() | runs.sql()
