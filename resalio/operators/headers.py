"""Header mapping: which column of a sheet is which field (H1 to H8)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.shared import dealt

LEAST = 0.60
FIELDS = list(V.COLUMN_NAMES)
#: All words of columns; a cell that scores for any of them, 0.72 at least, speaks for a header.
VOCABULARY = list(dict.fromkeys(w for ws in V.COLUMN_NAMES.values() for w in ws))


def word_score(norm: Column, word: Column) -> Column:
    """How well a normalised header fits a word."""
    long_word = F.length(word) >= 4
    return F.when(norm == word, 1.0).when(norm.startswith(word) & long_word, 0.88).when(norm.contains(word) & long_word, 0.82).when(word.contains(norm) & (F.length(norm) >= 4), 0.72).otherwise(0.0)


def any_score(norm: Column, words: list[str]) -> Column:
    """Whether a normalised header that isn't empty has a score above 0 for any of the words: what word_score tells, all words at once."""
    holds = norm.rlike("|".join(re.escape(w) for w in words if len(w) >= 4)) if any(len(w) >= 4 for w in words) else F.lit(False)
    return norm.isin(words) | holds | ((F.length(norm) >= 4) & F.lit("\u0001".join(words)).contains(norm))


def score_headers(headers: DataFrame) -> DataFrame:
    """H1: headers (catalog_id, col_idx, header) scored per field: field, field_order, score, keyword; scores above 0.

    The vocabulary is an array literal of fixed size, so headers are neither joined nor shuffled.
    """
    words = {f: list(dict.fromkeys(ws)) for f, ws in V.COLUMN_NAMES.items()}
    told = [F.when(any_score(F.col("norm"), ws), F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_order"), F.array(*[F.lit(w) for w in ws]).alias("words"))) for i, (f, ws) in enumerate(words.items())]
    df = headers.withColumn("norm", T.norm_header("header")).filter("norm <> ''").withColumn("f", F.explode(F.array_compact(F.array(*told))))
    best = F.array_max(F.transform("f.words", lambda w, k: F.struct(word_score(F.col("norm"), w).alias("score"), (-k).alias("k"), w.alias("word"))))
    df = df.withColumn("best", best).filter("best.score > 0")
    return df.select(*headers.columns, "norm", "f.field", "f.field_order", "best.score", F.col("best.word").alias("keyword"))


def is_ignored(norm: Column) -> Column:
    """H2: a header that holds any word of columns that say nothing."""
    return norm.rlike("|".join(w.replace(".", r"\.") for w in V.IGNORED_COLUMNS))


def field_of_header(scored: DataFrame) -> DataFrame:
    """H3: each header's best field, from 0.60 on; ties by order of fields."""
    w = Window.partitionBy("catalog_id", "col_idx").orderBy(F.desc("score"), "field_order")
    return scored.filter(~is_ignored(F.col("norm"))).withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) & (F.col("score") >= LEAST)).drop("__n")


def map_headers(headers: DataFrame) -> DataFrame:
    """H4: one header per field and catalog: the best score, then the first column."""
    w = Window.partitionBy("catalog_id", "field").orderBy(F.desc("score"), "col_idx")
    return field_of_header(score_headers(headers)).withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("catalog_id", "field", "col_idx", "header", "score", "keyword")


def score_header_rows(raw_rows: DataFrame, first: int = 12) -> DataFrame:
    """H5: how much each of the first rows (catalog_id, sheet, row_idx, cells) looks like a header."""
    cell = F.trim(F.replace(F.replace("c", F.lit("R$"), F.lit("")), F.lit(","), F.lit(".")))
    number = cell.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    long_cell = F.length("c") > 60
    cells = raw_rows.filter(F.col("row_idx") < first).select("catalog_id", "sheet", "row_idx", F.explode("cells").alias("c")).filter(F.trim("c") != "")
    # the norm is a column of its own, so that it is worked out once a cell
    hit = (F.col("norm") != "") & any_score(F.col("norm"), VOCABULARY)
    marks = cells.withColumn("norm", T.norm_header("c")).withColumns({"text": (~long_cell & ~number).cast("int"), "hit": (~long_cell & hit).cast("int"), "long": long_cell.cast("int")})
    rows = marks.groupBy("catalog_id", "sheet", "row_idx").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("text", "hit", "long")])
    total = F.col("text") + 3.0 * F.col("hit") - 0.5 * F.col("long") - F.when(F.col("text") < F.col("n") * 0.5, 3.0).otherwise(0.0) + F.when(F.col("hit") >= 2, 2.0).otherwise(0.0)
    return rows.select("catalog_id", "sheet", "row_idx", total.alias("score"))


def detect_header_row(raw_rows: DataFrame, first: int = 12) -> DataFrame:
    """H6: per sheet the row with the best score, the earliest of equals; confidence is a tenth of it, 1 at most."""
    best = F.max_by("row_idx", F.struct("score", -F.col("row_idx"))).alias("header_row")
    found = score_header_rows(raw_rows, first).groupBy("catalog_id", "sheet").agg(best, F.max("score").alias("score"))
    sure = F.when(F.col("score") > 0, F.least(F.col("score") / 10, F.lit(1.0))).otherwise(0.0)
    return found.select("catalog_id", "sheet", "header_row", sure.alias("header_confidence"), (sure < 0.3).alias("header_warning"))


def mapping_status(mapped: DataFrame) -> DataFrame:
    """H7: per catalog the column of each field, whether name and cost are there, and which others are missing."""
    wide = mapped.groupBy("catalog_id").pivot("field", FIELDS).agg(F.first("col_idx"))
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in ("sku", "category", "supplier")]))
    return wide.withColumns({"has_required": F.col("product_name").isNotNull() & F.col("cost").isNotNull(), "missing_optional": missing})


def find_precision_cols(headers: DataFrame) -> DataFrame:
    """H8: per catalog the first columns that hold a query, a model code and a brand; null where there is none."""
    norm = T.norm_header("header")
    first = lambda words: F.min(F.when(F.greatest(*[norm.contains(w) for w in words]), F.col("col_idx")))
    return headers.groupBy("catalog_id").agg(first(V.QUERY_COLUMNS).alias("query_col"), first(V.MODEL_COLUMNS).alias("model_col"), first(V.BRAND_COLUMNS).alias("brand_col"))


def page_tables(tables: DataFrame, first: int = 5) -> DataFrame:
    """H7 for tables of pages (catalog_id, table_idx, row_idx, cells): catalog_id, table_idx, header_row and the column of each field, for tables of two rows or more whose best header row, or else row 0, names a product and a cost.

    A table's header is looked for among its first rows; where that row has no columns of names and costs, row 0 is
    tried. There may be more tables than a driver holds, in files that are small: no side of a join is broadcast.
    """
    keyed = tables.withColumn("sheet", F.col("table_idx").cast("string"))
    long_enough = keyed.groupBy("catalog_id", "sheet").agg(F.count("*").alias("__n")).filter("__n > 1").select("catalog_id", "sheet")
    found = detect_header_row(keyed.join(dealt(long_enough), ["catalog_id", "sheet"], "left_semi"), first).select("catalog_id", "sheet", F.col("header_row").alias("best"))
    # one table's two candidates are two catalogs to the mapping
    tried = found.select("catalog_id", "sheet", F.explode(F.array_distinct(F.array("best", F.lit(0).cast("int")))).alias("row_idx"), "best").withColumn("__key", F.concat_ws("\u0001", "catalog_id", "sheet", F.col("row_idx").cast("string")))
    heads = keyed.filter(F.col("row_idx") < first).join(dealt(tried), ["catalog_id", "sheet", "row_idx"]).select("catalog_id", "table_idx", "row_idx", "best", "__key", F.col("cells"))
    names = heads.select(F.col("__key").alias("catalog_id"), F.posexplode("cells").alias("col_idx", "header")).filter("header IS NOT NULL")
    mapping = mapping_status(map_headers(names)).filter("has_required").withColumnRenamed("catalog_id", "__key")
    good = heads.drop("cells").join(dealt(mapping.select("__key", *FIELDS)), "__key")
    chosen = good.groupBy("catalog_id", "table_idx").agg(F.max_by(F.struct(F.col("row_idx").alias("header_row"), *FIELDS), (F.col("row_idx") == F.col("best")).cast("int")).alias("m"))
    return chosen.select("catalog_id", "table_idx", "m.*")
