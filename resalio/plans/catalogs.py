"""Whole runs over catalogs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import finance as fin
from ..operators import headers as H
from ..functions import text as T
from ..operators import market as mkt
from ..operators import matching as M
from ..operators import rows as R
from ..operators import scoring
from ..sources import sinks
from ..sources.shared import Run, dealt, materialize


@dataclass(frozen=True)
class Analysis:
    """What a run makes of products and their listings."""

    products: DataFrame
    market: DataFrame
    finance: DataFrame
    scores: DataFrame
    listings: DataFrame | None = None
    quarantine: DataFrame | None = None


def parse(raw_rows: DataFrame, most: int = R.LARGE) -> tuple[DataFrame, DataFrame]:
    """Raw sheets (catalog_id, sheet_idx, sheet, row_idx, cells) to accepted products and the quality of each catalog.

    A catalog without columns of names and costs, or without any row that isn't blank, has counters of 0 and FAILED.
    """
    rows = raw_rows.join(materialize(R.best_sheets(raw_rows), "best-sheets"), ["catalog_id", "sheet_idx"], "left_semi")
    at = materialize(H.detect_header_row(rows), "header-rows")
    marked = rows.join(at.select("catalog_id", "sheet", "header_row"), ["catalog_id", "sheet"])
    heads = marked.filter("row_idx = header_row").select("catalog_id", F.posexplode("cells").alias("col_idx", "header")).filter("header IS NOT NULL")
    mapping = materialize(H.mapping_status(H.map_headers(heads)).filter("has_required"), "mapping")
    large = R.large_sheets(rows, most)
    data = R.cut_after_blank_run(marked.filter("row_idx > header_row").drop("header_row").join(mapping.select("catalog_id"), "catalog_id", "left_semi"), large=large)
    classified = materialize(R.classify_rows(data, mapping), "classified")
    accepted = R.flag_dup_sku(R.fill_category(classified.filter("skip_reason IS NULL"), large), large)
    flags = accepted.filter("is_dup_sku").select("catalog_id", "sheet", "row_idx", "is_dup_sku")
    stats = R.parse_stats(classified.join(flags, ["catalog_id", "sheet", "row_idx"], "left").withColumn("is_dup_sku", F.coalesce("is_dup_sku", F.lit(False))))
    counters = [c for c in stats.columns if c != "catalog_id"]
    every = raw_rows.select("catalog_id").distinct().join(stats, "catalog_id", "left").na.fill(0, counters)
    quality = R.parse_confidence(R.parse_rates(every.join(mapping.select("catalog_id", "has_required"), "catalog_id", "left")), "has_required")
    products = accepted.select("catalog_id", F.concat_ws("-", "catalog_id", F.col("row_idx").cast("string")).alias("product_id"), "raw_name", F.lit(None).cast("string").alias("normalized_name"), "sku", "category", "supplier", "cost", "is_dup_sku")
    return R.gate(products, quality), quality


def parse_csv(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of CSV files (read_csv_files) to accepted products and the quality of each file.

    A file without a dialect, without columns of names and costs or without records is FAILED with counters of 0.
    product_id is the file and the record's number.
    """
    fields = materialize(R.csv_fields(rows), "csv-fields")
    good = R.clean_csv_rows(fields)
    products = good.select("catalog_id", F.concat_ws("-", "catalog_id", F.col("row_idx").cast("string")).alias("product_id"), "raw_name", "normalized_name", "sku", "category", "supplier", "cost")
    named = ~F.lower(F.coalesce("raw_name", F.lit(""))).isin("nan", "none", "")
    counts = fields.groupBy("catalog_id").agg(F.count("*").alias("total_rows_scanned"), F.count_if(~named).alias("skipped_invalid_name")).join(dealt(good.groupBy("catalog_id").agg(F.count("*").alias("valid_products"))), "catalog_id", "left")
    every = rows.select("catalog_id").distinct().join(dealt(counts), "catalog_id", "left").na.fill(0, ["total_rows_scanned", "skipped_invalid_name", "valid_products"])
    zero = F.lit(0).cast("long")
    stats = every.withColumns({"skipped_invalid_cost": F.col("total_rows_scanned") - F.col("skipped_invalid_name") - F.col("valid_products"), "skipped_empty": zero, "skipped_subtotal": zero, "duplicate_skus": zero})
    level = F.when(F.col("success_rate") >= 0.80, "RELIABLE").when(F.col("valid_products") > 0, "PARTIAL").otherwise("FAILED")
    return products, R.parse_rates(stats).withColumn("confidence", level).drop("skipped_empty", "skipped_subtotal", "duplicate_skus")


def analyze(products: DataFrame, listings: DataFrame, config: fin.FeeConfig = fin.FeeConfig.from_settings(), min_sales: int = 0, run: Run | None = None) -> Analysis:
    """I1 from listings on: market, finance, scores. Each stage is written and read by the next, so listings are read once.

    A run that stopped goes on after its last complete stage, if it is given again.
    """
    spark, kept = products.sparkSession, run is not None
    run = run or Run(spark)
    market = run.stage("market", lambda: mkt.market_analysis(mkt.sales_filter(listings, min_sales)))
    tried = run.stage("finance", lambda: fin.attempt(products, market, config))
    finance = fin.results(tried)
    ranked = lambda: scoring.score_catalog(finance, written=True)
    top = mkt.top_listings(listings) if "position" in listings.columns else None
    return Analysis(products, market, finance, run.stage("scores", ranked) if kept else ranked(), top, fin.quarantine(tried))


def run_pipeline(raw_rows: DataFrame, results: DataFrame, config: fin.FeeConfig = fin.FeeConfig.from_settings(), min_sales: int = 0, min_confidence: float = 0.15, run: Run | None = None) -> tuple[DataFrame, Analysis]:
    """I1 whole: catalogs' sheets and search results (query, position, listing columns) to quality and analyses.

    Accepted products search by their names (T10), listings are scored against them and qualified in two phases (M13).
    Stages (products and quality, listings, market, finance, scores) are complete or not there: a run that stopped is
    given again to go on.
    """
    run = run or Run(raw_rows.sparkSession)
    products, quality = run.stages(["products", "quality"], lambda: parse(raw_rows))

    def matched() -> DataFrame:
        asked = M.prepare(products.select("product_id", "raw_name", T.search_query("raw_name").alias("query")), "raw_name", "catalog")
        found = M.two_phase_match(asked, M.prepare(results, "title", "listing"), min_sales, min_confidence)
        return found.drop("raw_name", *[c for c in found.columns if c.startswith(("catalog_", "listing_")) and c != "listing_type"])

    listings = run.stage("listings", matched)
    return quality, analyze(products, listings, config, min_sales, run)


def rerun_analysis(products: DataFrame, listings: DataFrame, market: DataFrame, config: fin.FeeConfig = fin.FeeConfig.from_settings()) -> Analysis:
    """Market rows are kept, missing ones worked out; finance and scores are made anew."""
    missing = mkt.pending(products, market)
    new = mkt.market_analysis(listings.join(missing.select("product_id"), "product_id", "left_semi"))
    whole = materialize(sinks.upsert(market, new.select(*market.columns)), "market")
    tried = materialize(fin.attempt(products, whole, config), "finance")
    finance = fin.results(tried)
    return Analysis(products, whole, finance, scoring.score_catalog(finance, written=True), quarantine=fin.quarantine(tried))


def latest_status(events: DataFrame) -> DataFrame:
    """I4: the last status of each catalog in an append-only log (catalog_id, status, ts)."""
    return events.groupBy("catalog_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("since"), F.count("*").alias("changes"))
