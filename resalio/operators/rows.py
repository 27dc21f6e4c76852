"""Row cleaning and parse quality (R1 to R16) over raw rows (catalog_id, sheet, row_idx, cells)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import price as P
from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.shared import dealt, materialize
from . import headers as H
from .ordering import carried

SHEET = ["catalog_id", "sheet"]
#: Rows of a sheet that one task orders at most.
LARGE = 2_000_000


def is_empty_row() -> Column:
    """R2."""
    return F.forall("cells", lambda c: c.isNull() | (F.trim(c) == ""))


def best_sheets(raw_rows: DataFrame, first: int = 1000) -> DataFrame:
    """catalog_id, sheet_idx of each catalog's sheet with most rows among the first; auxiliary sheets only if all are; ties keep order.

    raw_rows has sheet_idx beside sheet.
    """
    norm = T.norm_header("sheet")
    other = norm.rlike("|".join(T_bare(w) for w in V.OTHER_SHEETS))
    counts = raw_rows.groupBy("catalog_id", "sheet_idx", "sheet").agg(F.count_if(~is_empty_row() & (F.col("row_idx") < first)).alias("n")).withColumn("other", other)
    order = F.struct(~F.col("other"), F.when(F.col("other"), 0).otherwise(F.col("n")), -F.col("sheet_idx"))
    return counts.groupBy("catalog_id").agg(F.max_by("sheet_idx", order).alias("sheet_idx"))


def select_sheet(raw_rows: DataFrame, first: int = 1000) -> DataFrame:
    """The rows of those sheets."""
    return raw_rows.join(best_sheets(raw_rows, first), ["catalog_id", "sheet_idx"], "left_semi")


def T_bare(word: str) -> str:
    """A fixed word without accents, as the headers it is looked for in."""
    return word.translate(str.maketrans(V.ACCENTED, V.BARE))


def large_sheets(raw_rows: DataFrame, most: int = LARGE) -> DataFrame | None:
    """catalog_id, sheet of sheets with more rows than one task should order: over `most`, and over a 10,000th of all, so that they are 10,000 at most; None if there are none."""
    counts = raw_rows.groupBy(*SHEET).agg(F.count("*").alias("rows"))
    largest, total = counts.agg(F.max("rows"), F.sum("rows")).first()
    limit = max(most, (total or 0) // 10_000)
    return materialize(counts.filter(F.col("rows") > limit).select(*SHEET), "large-sheets") if (largest or 0) > limit else None


def by_size(df: DataFrame, large: DataFrame | None, small_way: Callable[[DataFrame], DataFrame], large_way: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of large sheets by one way, all others by the other."""
    if large is None:
        return small_way(df)
    known = F.broadcast(large)  # 10,000 rows at most
    return small_way(df.join(known, SHEET, "left_anti")).unionByName(large_way(df.join(known, SHEET, "left_semi")))


def cut_after_blank_run(df: DataFrame, run: int = 10, large: DataFrame | None = None) -> DataFrame:
    """The rows of each sheet before its first run of so many blank rows ends; blank_stop tells whether there was one.

    Sheets named in `large` (large_sheets) are numbered in many tasks; the number of the last row that isn't blank is
    carried along, and what a row's number is beyond it is its run.
    """

    def small_way(df: DataFrame) -> DataFrame:
        by = Window.partitionBy(*SHEET).orderBy("row_idx")
        df = df.withColumn("__blank", is_empty_row()).withColumn("__island", F.sum(F.when(F.col("__blank"), 0).otherwise(1)).over(by))
        inside = Window.partitionBy(*SHEET, "__island").orderBy("row_idx")
        df = df.withColumn("__n", F.sum(F.col("__blank").cast("int")).over(inside))
        stop = F.min(F.when(F.col("__n") >= run, F.col("row_idx"))).over(Window.partitionBy(*SHEET))
        df = df.withColumn("__stop", stop).filter(F.col("__stop").isNull() | (F.col("row_idx") <= F.col("__stop")))
        return df.withColumn("blank_stop", F.col("__stop").isNotNull()).drop("__blank", "__island", "__n", "__stop")

    def large_way(df: DataFrame) -> DataFrame:
        rows = carried(df, SHEET, ["row_idx"], {"__full": F.when(~is_empty_row(), F.col("__no"))}, number="__no")
        rows = materialize(rows.withColumn("__run", F.col("__no") - F.coalesce("__full", F.lit(0))), "runs")
        stops = rows.filter(F.col("__run") >= run).groupBy(*SHEET).agg(F.min("row_idx").alias("__stop"))
        rows = rows.join(F.broadcast(stops), SHEET, "left").filter(F.col("__stop").isNull() | (F.col("row_idx") <= F.col("__stop")))  # a row of each large sheet
        return rows.withColumn("blank_stop", F.col("__stop").isNotNull()).drop("__no", "__full", "__run", "__stop")

    return by_size(df, large, small_way, large_way)


def first_text() -> Column:
    """The first cell of a row that isn't empty."""
    return F.get(F.filter("cells", lambda c: F.trim(c) != ""), F.lit(0))


def is_subtotal(first: Column, name: Column) -> Column:
    """R4, on normalised texts: the first cell that isn't empty holds a word of totals, or the name starts with one."""
    words = "|".join(T_bare(w) for w in V.SUBTOTALS)
    return F.coalesce(first.rlike(words), F.lit(False)) | F.coalesce(name.rlike(f"^({words})"), F.lit(False))


def is_header_repeat(name: Column) -> Column:
    """R5, on a normalised name."""
    return F.coalesce(name.isin(V.RESERVED_NAMES), F.lit(False))


def is_valid_name(name: Column, norm: Column) -> Column:
    """R6."""
    return F.coalesce(F.length(name).between(2, 300) & ~name.rlike(r"^[\d\s.\-/]+$") & ~norm.isin(V.RESERVED_NAMES), F.lit(False))


def cell(field: str) -> Column:
    """A field's cell by the catalog's mapping; null if it has none."""
    return F.when(F.col(field).isNotNull() & (F.col(field) >= 0), F.get("cells", F.col(field)))


def classify_rows(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Data rows with skip_reason (null: accepted) and the parsed fields. mapping: H7's columns per catalog; rows of a catalog without one are kept, and refused."""
    df = rows.join(mapping.select("catalog_id", "product_name", "cost", "sku", "category", "supplier"), "catalog_id", "left")
    # worked out once a row, as columns of their own
    df = df.withColumns({"__raw": cell("product_name"), "__first": first_text()})
    df = df.withColumns({
        "raw_name": T.clean_text("__raw"), "price": P.parse_price(cell("cost")), "sku_text": T.clean_sku(cell("sku")), "__norm": T.norm_header("__raw"), "__first": T.norm_header("__first"),
        "category_text": T.clean_text(cell("category")), "supplier_text": T.clean_text(cell("supplier")), "__empty": is_empty_row(),
    })
    subtotal, repeat, named = is_subtotal(F.col("__first"), F.col("__norm")), is_header_repeat(F.col("__norm")), is_valid_name(F.col("raw_name"), F.col("__norm"))
    reason = F.when(F.col("__empty"), "empty").when(subtotal, "subtotal").when(repeat, "header_repeat").when(~named, "invalid_name").when(~P.is_valid_cost("price"), "invalid_cost")
    df = df.withColumn("skip_reason", reason).withColumn("cost_unparsed", F.coalesce(F.col("skip_reason") == "invalid_cost", F.lit(False)) & F.col("price").isNull())
    keep = [c for c in rows.columns]
    return df.select(*keep, "skip_reason", "cost_unparsed", "raw_name", F.col("price").alias("cost"), F.col("sku_text").alias("sku"), F.col("category_text").alias("category"), F.col("supplier_text").alias("supplier"))


def fill_category(accepted: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """A missing category is the last one above it among accepted rows. Sheets named in `large` are filled in many tasks."""
    by = Window.partitionBy(*SHEET).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda df: df.withColumn("category", F.last("category", ignorenulls=True).over(by))
    far = lambda df: carried(df, SHEET, ["row_idx"], {"__last": F.col("category")}).withColumn("category", F.col("__last")).drop("__last")
    return by_size(accepted, large, last, far)


def flag_dup_sku(df: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """is_dup_sku for all but the first row of a SKU in a catalog. In sheets named in `large` the first rows are counted before they are joined, and Spark splits a hot SKU's join."""
    sku = F.upper(F.trim("sku"))
    known = F.col("sku").isNotNull() & (F.trim("sku") != "")

    def small_way(df: DataFrame) -> DataFrame:
        by = Window.partitionBy("catalog_id", sku).orderBy("row_idx")
        return df.withColumn("is_dup_sku", known & (F.row_number().over(by) > 1))

    def large_way(df: DataFrame) -> DataFrame:
        rows = df.withColumn("__sku", F.when(known, sku))
        first = materialize(rows.filter("__sku IS NOT NULL").groupBy("catalog_id", "__sku").agg(F.min("row_idx").alias("__first")), "first-skus")
        return rows.join(first, ["catalog_id", "__sku"], "left").withColumn("is_dup_sku", F.coalesce(F.col("row_idx") > F.col("__first"), F.lit(False))).drop("__sku", "__first")

    return by_size(df, large, small_way, large_way)


def dedup_names(df: DataFrame) -> DataFrame:
    """The first row of each name, whatever its case; it holds the name even if its cost is refused, as is then dropped."""
    first = df.groupBy("catalog_id", F.lower("raw_name").alias("__name")).agg(F.min("row_idx").alias("__first"))
    named = df.withColumn("__name", F.lower("raw_name")).join(first, ["catalog_id", "__name"])
    return named.filter((F.col("row_idx") == F.col("__first")) & P.is_valid_cost("cost")).drop("__name", "__first")


def clean_csv_rows(df: DataFrame) -> DataFrame:
    """Rows (raw_name, cost_text) with a name that says something and a valid cost."""
    name = F.trim("raw_name")
    return df.withColumn("cost", P.parse_price("cost_text")).filter(~F.lower(F.coalesce(name, F.lit(""))).isin("nan", "none", "") & P.is_valid_cost("cost")).withColumn("raw_name", name)


def csv_fields(rows: DataFrame) -> DataFrame:
    """R11 with H4 and H8: records of CSV files (catalog_id, row_idx, cells; row 0 is the header) as raw_name, cost_text, sku, category, supplier and normalized_name.

    Files without columns of names and costs have no rows. A name that says what to search for is the query column's,
    else the model's code with the brand before it; the supplier's column is the brand's, where there is one.
    """
    heads = rows.filter("row_idx = 0").select("catalog_id", F.posexplode("cells").alias("col_idx", "header"))
    mapping = H.mapping_status(H.map_headers(heads)).filter("has_required").join(dealt(H.find_precision_cols(heads)), "catalog_id", "left")
    df = rows.filter("row_idx > 0").select("catalog_id", "row_idx", "cells").join(dealt(mapping), "catalog_id")  # a row of each file: as many as there are files
    bare = lambda c: F.regexp_replace(cell(c), r"^\s+|\s+$", "")
    said = lambda c: F.get(F.filter(F.array(bare(c)), lambda v: ~F.lower(v).isin("nan", "none", "")), F.lit(0))
    df = df.withColumn("brand_col", F.coalesce("supplier", "brand_col"))
    fields = {"raw_name": bare("product_name"), "cost_text": bare("cost"), "query": said("query_col"), "model": said("model_col"), "brand": said("brand_col"), **{f"of_{c}": said(c) for c in ("sku", "category", "supplier")}}
    found = df.select("catalog_id", "row_idx", F.col("brand_col").isNotNull().alias("coded"), *[v.alias(k) for k, v in fields.items()])
    precise = T.precision_name("query", "brand", F.when(F.col("coded"), F.col("model")))
    return found.select("catalog_id", "row_idx", "raw_name", "cost_text", *[F.col(f"of_{c}").alias(c) for c in ("sku", "category", "supplier")], precise.alias("normalized_name"))


def first_usable_table(df: DataFrame) -> DataFrame:
    """Of each catalog's tables (table_idx, skip_reason) the rows of the first that has an accepted row."""
    first = df.filter("skip_reason IS NULL").groupBy("catalog_id").agg(F.min("table_idx").alias("table_idx"))
    return df.join(first, ["catalog_id", "table_idx"], "left_semi")


def parse_stats(rows: DataFrame, run: int = 10) -> DataFrame:
    """Counters per catalog of classified rows. A stop at a run of blanks takes the run off the scanned rows."""
    reasons = ["empty", "subtotal", "header_repeat", "invalid_name", "invalid_cost"]
    stop = F.coalesce(F.max(F.col("blank_stop").cast("int")), F.lit(0)) * run if "blank_stop" in rows.columns else F.lit(0)
    dup = F.count_if("is_dup_sku") if "is_dup_sku" in rows.columns else F.lit(0).cast("long")
    return rows.groupBy("catalog_id").agg(
        (F.count("*") - stop).cast("long").alias("total_rows_scanned"),
        F.count_if(F.col("skip_reason").isNull()).alias("valid_products"),
        *[F.count_if(F.col("skip_reason") == r).alias(f"skipped_{r}") for r in reasons],
        F.count_if("cost_unparsed").alias("cost_parse_errors"),
        dup.alias("duplicate_skus"),
    )


def parse_rates(stats: DataFrame) -> DataFrame:
    """Valid rows of those that aren't blank, and refused and doubled ones of all; four places, half even, 0 of none."""
    share = lambda a, b: F.coalesce(F.bround(F.try_divide(a.cast("double"), b.cast("double")), 4), F.lit(0.0))
    skipped = F.col("skipped_invalid_name") + F.col("skipped_invalid_cost") + F.col("skipped_subtotal") + F.col("duplicate_skus")
    return stats.withColumns({"success_rate": share(F.col("valid_products"), F.col("total_rows_scanned") - F.col("skipped_empty")), "skip_rate": share(skipped, F.col("total_rows_scanned"))})


def parse_confidence(rates: DataFrame, has_required: str | None = None) -> DataFrame:
    """RELIABLE, PARTIAL or FAILED."""
    needed = F.coalesce(F.col(has_required), F.lit(False)) if has_required else F.lit(True)
    level = F.when(~needed, "FAILED").when(F.col("success_rate") >= 0.80, "RELIABLE").when((F.col("success_rate") >= 0.20) | (F.col("valid_products") > 0), "PARTIAL").otherwise("FAILED")
    return rates.withColumn("confidence", level)


def gate(rows: DataFrame, quality: DataFrame) -> DataFrame:
    """Rows of catalogs that didn't fail and have products."""
    return rows.join(quality.filter("confidence <> 'FAILED' AND valid_products > 0").select("catalog_id"), "catalog_id", "left_semi")
