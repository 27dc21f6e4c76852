"""Queries on raw sheets and headers (H, R, S1, S10), made of the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import price as P
from ..functions import vocabulary as V
from ..operators import headers as H
from ..operators import rows as R
from ..oracles import bare, squeeze
from ..plans import catalogs
from ..sources import csv_files, driver, sinks
from ..sources.shared import materialize, new_folder

#: Headers of catalogs by their number modulo 5. The last have no known column.
HEADS = [["Produto", "Custo", "SKU", "Categoria", "Fornecedor"], ["Nome do Produto", "Preço de Custo", "Código", "Grupo", "Marca"], ["DESCRIÇÃO", "VALOR UNITÁRIO", "REF", "TIPO", "FABRICANTE"], ["Product Name", "Unit Price", "Quantidade", "Observação", "Margem"], ["foo", "bar", "xyz", "qqq", "zzz"]]
#: A number in letters, as names have it.
LETTERS = ("0123456789", "abcdefghij")
NAME = "'Luva x'||translate(CAST(pk AS VARCHAR), '0123456789', 'abcdefghij')"
WORDS = [w for ws in V.COLUMN_NAMES.values() for w in dict.fromkeys(ws)]


def row(*cells) -> Column:
    return F.array(*[c if isinstance(c, Column) else F.lit(c).cast("string") for c in cells])


def raw_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Catalogs of three sheets: titles, a header, lines as rows of ten kinds (blank, total, heading, bad name, bad cost, good); in some ten blank rows and a row after them."""
    lines = driver.sheet_lines(spark, d).select(F.col("catalog_id").cast("long").alias("c"), "n", (F.col("l_quantity").cast("long") % 10).alias("k"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), (F.col("l_linenumber") == 1).alias("first"), F.col("l_returnflag").alias("rf"))
    kind = F.when((F.col("c") % 7 == 0) & F.col("k").between(1, 5), 6).when((F.col("c") % 11 == 0) & (F.col("k") >= 6), 4).otherwise(F.col("k"))
    tail = lines.groupBy("c").agg(F.max("n").alias("m")).filter("c % 2 = 0").select("c", F.explode(F.sequence(F.lit(1), F.lit(11))).alias("i"), "m")
    tail = tail.select("c", (F.col("m") + F.col("i")).alias("n"), F.when(F.col("i") == 11, 9).otherwise(0).cast("long").alias("k"), F.lit(7).cast("long").alias("pk"), F.lit(7).cast("long").alias("sk"), F.lit(False).alias("first"), F.lit("X").alias("rf"))
    both = lines.withColumn("k", kind.cast("long")).unionByName(tail)
    cents = F.col("pk") * 7 % 90000 + 1
    cost = F.concat(F.lit("R$ "), F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    good = row(F.concat(F.lit(" Luva\t x"), F.translate(F.col("pk").cast("string"), *LETTERS)), cost, F.concat(F.lit("00"), F.col("pk").cast("string")), F.when(F.col("first"), F.concat(F.lit("Cat "), F.col("rf"))), F.concat(F.lit("Forn "), F.col("sk").cast("string")))
    k, plain = F.col("k"), F.col("c") % 5 < 3
    cells = (
        F.when(k == 0, row(" ", None, "", None, None)).when(k == 1, row("", "Subtotal geral", "100", None, None)).when((k == 2) & plain, row(*HEADS[0])).when(k == 2, row("produto", None, None, None, None))
        .when(k == 3, row("12345-6", "10,00", "1", None, "x")).when(k == 4, row("Luva ruim", "abc", "2", None, "x")).when(k == 5, row("Luva gratis", "0,00", "3", None, "x")).otherwise(good)
    )
    titled = F.col("c") % 3 == 0
    head = F.when(titled, 3).otherwise(0)
    name = lambda k, w: F.when(F.col("c") % 13 == 0, F.lit(k)).otherwise(F.lit(w))
    data = both.select("c", F.lit(1).alias("sheet_idx"), name("Config 2", "Produtos").alias("sheet"), (head + F.col("n")).alias("row_idx"), cells.alias("cells"))
    each = both.select("c").distinct()
    header = F.array(*[row(*h) for h in HEADS])[(F.col("c") % 5).cast("int")]
    top = F.when(titled, F.array(row("Tabela de preços", None), row("Lista 2024", None), row(" ", None), header)).otherwise(F.array(header))
    heads = each.select("c", F.lit(1).alias("sheet_idx"), name("Config 2", "Produtos").alias("sheet"), F.posexplode(top).alias("row_idx", "cells"))
    others = each.select("c", F.inline(F.array(F.struct(F.lit(0).alias("sheet_idx"), F.lit("Configuração").alias("sheet"), F.lit(0).alias("row_idx"), row("chave", "valor").alias("cells")), F.struct(F.lit(2).alias("sheet_idx"), name("Legenda", "Resumo").alias("sheet"), F.lit(0).alias("row_idx"), row("a", "b").alias("cells")))))
    return materialize(data.unionByName(heads).unionByName(others).withColumn("catalog_id", F.col("c").cast("string")).drop("c"), "sheets")


SHEETS = """WITH line AS (
  SELECT l_orderkey//64 AS cid, row_number() OVER (PARTITION BY l_orderkey//64 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag) AS n,
    CAST(l_quantity AS BIGINT)%10 AS k, l_partkey AS pk, l_suppkey AS sk, l_linenumber=1 AS first, l_returnflag AS rf FROM lineitem),
kinds AS (SELECT * REPLACE (CASE WHEN cid%7=0 AND k BETWEEN 1 AND 5 THEN 6 WHEN cid%11=0 AND k>=6 THEN 4 ELSE k END AS k) FROM line),
tail AS (SELECT cid, m+i AS n, CASE WHEN i=11 THEN 9 ELSE 0 END AS k, 7 AS pk, 7 AS sk, false AS first, 'X' AS rf FROM (SELECT cid, max(n) AS m FROM line WHERE cid%2=0 GROUP BY cid), range(1, 12) t(i)),
sheet AS (SELECT *, CASE WHEN cid%3=0 THEN 3 ELSE 0 END AS head FROM (SELECT * FROM kinds UNION ALL SELECT * FROM tail)),
stops AS (SELECT cid, min(n) AS stop FROM (SELECT cid, n, sum(CASE WHEN k=0 THEN 1 ELSE 0 END) OVER (PARTITION BY cid ORDER BY n ROWS 9 PRECEDING) AS run FROM sheet) WHERE run=10 GROUP BY cid),
seen AS (SELECT sheet.*, stop, CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'subtotal' WHEN 2 THEN 'header_repeat' WHEN 3 THEN 'invalid_name' WHEN 4 THEN 'invalid_cost' WHEN 5 THEN 'invalid_cost' END AS reason,
    CASE WHEN cid%5<3 AND first THEN 'Cat '||rf END AS cat FROM sheet LEFT JOIN stops USING (cid) WHERE (stop IS NULL OR n<=stop) AND cid%5<4 AND cid%13<>0),
good AS (SELECT *, last_value(cat IGNORE NULLS) OVER (PARTITION BY cid ORDER BY n ROWS UNBOUNDED PRECEDING) AS category, row_number() OVER (PARTITION BY cid, pk ORDER BY n)>1 AND cid%5<3 AS dup FROM seen WHERE reason IS NULL),
stats AS (SELECT cid, CAST(count(*)-CASE WHEN max(stop) IS NULL THEN 0 ELSE 10 END AS BIGINT) AS total_rows_scanned, count(*) FILTER (WHERE reason IS NULL) AS valid_products, """ + ", ".join(f"count(*) FILTER (WHERE reason='{r}') AS skipped_{r}" for r in ("empty", "subtotal", "header_repeat", "invalid_name", "invalid_cost")) + """,
    count(*) FILTER (WHERE reason='invalid_cost') AS cost_parse_errors FROM seen GROUP BY cid),
counted AS (SELECT * FROM stats LEFT JOIN (SELECT cid, count(*) FILTER (WHERE dup) AS duplicate_skus FROM good GROUP BY cid) USING (cid)),
every AS (SELECT cid, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("total_rows_scanned", "valid_products", "skipped_empty", "skipped_subtotal", "skipped_header_repeat", "skipped_invalid_name", "skipped_invalid_cost", "cost_parse_errors", "duplicate_skus")) + """, counted.cid IS NOT NULL AS known FROM (SELECT DISTINCT cid FROM line) LEFT JOIN counted USING (cid)),
quality AS (SELECT *, coalesce(round_even(CAST(valid_products AS DOUBLE)/nullif(total_rows_scanned-skipped_empty, 0), 4), 0.0) AS success_rate,
    coalesce(round_even(CAST(skipped_invalid_name+skipped_invalid_cost+skipped_subtotal+duplicate_skus AS DOUBLE)/nullif(total_rows_scanned, 0), 4), 0.0) AS skip_rate FROM every),
judged AS (SELECT *, CASE WHEN NOT known THEN 'FAILED' WHEN success_rate>=0.8 THEN 'RELIABLE' WHEN success_rate>=0.2 OR valid_products>0 THEN 'PARTIAL' ELSE 'FAILED' END AS confidence FROM quality)"""
COUNTERS = "total_rows_scanned, valid_products, skipped_empty, skipped_subtotal, skipped_header_repeat, skipped_invalid_name, skipped_invalid_cost, cost_parse_errors, duplicate_skus"


def part_headers(spark: SparkSession, d: str) -> DataFrame:
    """Parts as headers, ten a catalog: words of the vocabulary alone, with other words around them, cut short, or none."""
    p = driver.read(spark, d, "part")
    word = F.array(*[F.lit(w) for w in WORDS])[(F.col("p_partkey") * 7 % len(WORDS)).cast("int")]
    s = F.col("p_size")
    header = F.when(s % 11 == 0, F.concat(F.lit("Tótal  "), word)).when(s % 5 == 0, F.upper(word)).when(s % 5 == 1, F.concat_ws(" ", word, "p_name")).when(s % 5 == 2, F.concat_ws("  ", "p_name", word)).when(s % 5 == 3, F.substring(word, 1, 5)).otherwise(F.col("p_type"))
    return p.select(F.floor(F.col("p_partkey") / 10).cast("string").alias("catalog_id"), (F.col("p_partkey") % 10).cast("int").alias("col_idx"), header.alias("header"))


def header_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = H.score_headers(part_headers(spark, d))
    return scored.select("catalog_id", "col_idx", "field", "score", "keyword", H.is_ignored(F.col("norm")).alias("ignored"))


def header_fields(spark: SparkSession, d: str) -> DataFrame:
    return H.field_of_header(H.score_headers(part_headers(spark, d))).select("catalog_id", "col_idx", "field", "score")


def header_mapping(spark: SparkSession, d: str) -> DataFrame:
    m = H.mapping_status(H.map_headers(part_headers(spark, d)))
    return m.select("catalog_id", *[F.col(f).cast("long").alias(f) for f in H.FIELDS], "has_required", F.array_join("missing_optional", ",").alias("missing"))


def precision_cols(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    header = F.when(n % 10 == 3, F.lit("Código  Modelo")).when((n % 10 == 5) & (n % 4 < 2), F.lit("MARCA do item")).when((n % 10 == 8) & (n % 3 == 0), F.lit("Query ML")).when(n % 10 == 9, F.lit("modelo")).otherwise(F.col("p_name"))
    cols = H.find_precision_cols(driver.read(spark, d, "part").select(F.floor(n / 10).cast("string").alias("catalog_id"), (n % 10).cast("int").alias("col_idx"), header.alias("header")))
    return cols.select("catalog_id", *[F.col(c).cast("long").alias(c) for c in ("query_col", "model_col", "brand_col")])


def sheet_choice(spark: SparkSession, d: str) -> DataFrame:
    return R.select_sheet(raw_sheets(spark, d)).groupBy("catalog_id", "sheet").agg(F.count_if(~R.is_empty_row()).alias("n"))


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    return H.detect_header_row(R.select_sheet(raw_sheets(spark, d))).select("catalog_id", F.col("header_row").cast("long").alias("header_row"), "header_confidence", "header_warning")


def classified_rows(spark: SparkSession, d: str) -> DataFrame:
    """R3 to R7 with the mapping that headers give."""
    raw = raw_sheets(spark, d)
    rows = raw.join(materialize(R.best_sheets(raw), "best-sheets"), ["catalog_id", "sheet_idx"], "left_semi")
    marked = rows.join(materialize(H.detect_header_row(rows).select("catalog_id", "header_row"), "header-rows"), "catalog_id")
    heads = marked.filter("row_idx = header_row").select("catalog_id", F.posexplode("cells").alias("col_idx", "header")).filter("header IS NOT NULL")
    mapping = materialize(H.mapping_status(H.map_headers(heads)).filter("has_required"), "mapping")
    data = R.cut_after_blank_run(marked.filter("row_idx > header_row").join(mapping.select("catalog_id"), "catalog_id", "left_semi"))
    ok = F.col("skip_reason").isNull()
    shown = {"raw_name": F.col("raw_name"), "cost": F.col("cost").cast("double"), "sku": F.col("sku"), "supplier": F.col("supplier")}
    return R.classify_rows(data, mapping).select("catalog_id", F.col("row_idx").cast("long").alias("row_idx"), "skip_reason", *[F.when(ok, v).alias(k) for k, v in shown.items()])


def parse_quality(spark: SparkSession, d: str) -> DataFrame:
    return catalogs.parse(raw_sheets(spark, d))[1].drop("has_required")


def parse_records(spark: SparkSession, d: str) -> DataFrame:
    counters = ["catalog_id", *COUNTERS.split(", ")]
    return sinks.parse_metadata(catalogs.parse(raw_sheets(spark, d))[1].select(*counters, "confidence"))


def parsed_products(spark: SparkSession, d: str) -> DataFrame:
    return catalogs.parse(raw_sheets(spark, d))[0].select("catalog_id", "product_id", "raw_name", F.col("cost").cast("double").alias("cost"), "sku", "category", "is_dup_sku")


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines as rows of page tables, one table an order: a name that comes again in other letters, a cost that may be none."""
    line = driver.sheet_lines(spark, d)
    name = F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("LUVA ")).otherwise(F.lit("Luva ")), (F.col("l_partkey") % 40).cast("string"))
    cents = F.col("l_partkey") % 3 * 100
    return line.select("catalog_id", (F.col("l_orderkey") % driver.ORDERS).cast("int").alias("table_idx"), F.col("n").alias("row_idx"), name.alias("raw_name"), (cents * F.lit("0.01").cast("decimal(3,2)")).cast(P.MONEY).alias("cost"), F.when(F.col("l_quantity") < 40, "invalid_cost").alias("skip_reason"))


def first_table(spark: SparkSession, d: str) -> DataFrame:
    return R.first_usable_table(table_rows(spark, d)).groupBy("catalog_id", "table_idx").agg(F.count("*").alias("n"))


def dedup_names(spark: SparkSession, d: str) -> DataFrame:
    return R.dedup_names(table_rows(spark, d)).select("catalog_id", F.col("row_idx").cast("long").alias("row_idx"), "raw_name")


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """R11 on lines: names of blanks and nans, costs of every style."""
    k = F.col("l_partkey") % 6
    name = F.when(k == 0, F.lit(" ")).when(k == 1, F.lit("NaN")).when(k == 2, F.lit("none ")).otherwise(F.concat(F.lit(" Luva "), F.col("l_partkey").cast("string")))
    cost = F.when(F.col("l_linenumber") == 2, F.lit("grátis")).when(F.col("l_linenumber") == 3, F.lit("1.000.000,00")).otherwise(F.concat(F.col("l_suppkey").cast("string"), F.lit(",5")))
    rows = driver.read(spark, d, "lineitem").select("l_orderkey", name.alias("raw_name"), cost.alias("cost_text"))
    return R.clean_csv_rows(rows).groupBy("raw_name", F.col("cost").cast("double").alias("cost")).agg(F.count("*").alias("n"))


def csv_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as CSV files of four separators and two encodings, and read again."""
    folder = new_folder(spark, "csv")
    p = driver.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("Código"), F.concat("p_name", F.lit(" maçã, doce")).alias("Descrição"), F.col("p_retailprice").cast("string").alias("Preço"))
    for k, sep in enumerate(csv_files.SEPARATORS):
        for j, encoding in enumerate(csv_files.ENCODINGS):
            part = p.filter(F.pmod(F.col("Código").cast("long"), F.lit(8)) == 2 * k + j)
            part.write.csv(f"{folder}/{k}{j}", header=True, sep=sep, encoding=encoding, quoteAll=True)
    record = F.col("record")
    rows = csv_files.csv_records(csv_files.read_csv_files(spark, f"{folder}/*"))
    return rows.select(record["Código"].alias("code"), record["Descrição"].alias("name"), record["Preço"].cast("double").alias("price"))


def many_csv(spark: SparkSession, d: str) -> DataFrame:
    """S1 on a file for every ten parts: headers of their own by file, four separators, quoted line ends, prices and names of none, some files without a dialect or without known columns."""
    part = driver.read(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("f"), F.col("p_partkey").alias("k"), "p_name", "p_brand")
    sep = F.element_at(F.array(*[F.lit(s) for s in csv_files.SEPARATORS]), (F.col("f") % 4 + 1).cast("int"))
    line = lambda *cells: F.concat_ws("\u0002", *cells)
    head = F.when(F.col("f") % 9 == 8, line(F.lit("foo"), F.lit("bar"), F.lit("x"), F.lit("y"))).otherwise(line(F.concat(F.lit("Produto "), F.col("f").cast("string")), F.lit("Preço de Custo"), F.lit("Código Modelo"), F.lit("Marca")))
    name = F.when(F.col("k") % 7 == 0, F.lit("nan")).otherwise(F.concat(F.lit('"'), F.col("p_name"), F.when(F.col("k") % 5 == 0, F.lit('\nlinha, 2; ""x"" |\t')).otherwise(F.lit("")), F.lit('"')))
    cost = F.when(F.col("k") % 11 == 0, F.lit("grátis")).otherwise(F.concat(F.lit('"R$ '), (F.col("k") % 900 + 1).cast("string"), F.lit(',50"')))
    rows = part.select("f", "k", sep.alias("sep"), head.alias("head"), line(name, cost, F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("M"), F.col("k").cast("string"))), F.col("p_brand")).alias("row"))
    files = rows.groupBy("f", "sep", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda r: r["row"]), "\n").alias("body"))  # ten rows
    content = F.when(F.col("f") % 13 == 12, F.lit("one column\nx")).otherwise(F.concat_ws("\n", "head", "body"))
    value = F.concat(F.replace(content, F.lit("\u0002"), "sep"), F.lit("\n"))
    named = files.select(F.floor(F.col("f") / 1000).cast("string").alias("folder"), F.format_string("f=%d.txt", "f").alias("name"), value.alias("value"))  # a thousand files a folder
    folders = sinks.write_files(named, new_folder(spark, "many-csv"))
    return csv_files.read_csv_folders(folders).withColumn("catalog_id", F.regexp_extract("catalog_id", "f=([0-9]+)", 1))


def many_csv_products(spark: SparkSession, d: str) -> DataFrame:
    products, _ = catalogs.parse_csv(materialize(many_csv(spark, d), "csv-rows"))
    return products.select("product_id", F.regexp_replace("raw_name", "\\s+", " ").alias("raw_name"), F.col("cost").cast("double").alias("cost"), "normalized_name", "supplier")


def many_csv_quality(spark: SparkSession, d: str) -> DataFrame:
    _, quality = catalogs.parse_csv(materialize(many_csv(spark, d), "csv-rows"))
    return quality.select("catalog_id", "total_rows_scanned", "valid_products", "skipped_invalid_name", "skipped_invalid_cost", "success_rate", "confidence")


def header_warnings(spark: SparkSession, d: str) -> DataFrame:
    """H5, H6 on sheets of two rows: numbers alone and a single text are doubtful headers; a product and a cost, or a product beside a number, aren't."""
    kind = F.col("o_orderkey") % 4
    head = F.when(kind == 0, row("10", "20,5")).when(kind == 1, row("Xyz", None)).when(kind == 2, row("Produto", "Custo")).otherwise(row("Produto", "10"))
    sheets_ = driver.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("catalog_id"), F.lit("s").alias("sheet"), F.posexplode(F.array(head, row("5", "7"))).alias("row_idx", "cells"))
    return H.detect_header_row(sheets_).select("catalog_id", F.col("header_row").cast("long").alias("header_row"), "header_confidence", "header_warning")


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """H7's fallback: tables of five lines whose header is their first row, a later one, the first one though a later one looks better, or none."""
    line = driver.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("kind"))
    good, other = row("Produto", "Custo", "Obs", None), row("Produto", "Produto Nome", "Item", "Código Modelo Marca SKU")
    filler = row("Luva", "10,00", "x", None)
    tables = F.when(F.col("kind") == 0, F.array(good, filler, filler)).when(F.col("kind") == 1, F.array(row("Lista", None, None, None), good, filler)).when(F.col("kind") == 2, F.array(good, other, filler)).otherwise(F.array(row("foo", "bar", "x", "y"), filler, filler))
    rows = line.select(F.floor(F.col("o_orderkey") / 50).cast("string").alias("catalog_id"), (F.col("o_orderkey") % 50).cast("int").alias("table_idx"), F.posexplode(tables).alias("row_idx", "cells"))
    return H.page_tables(materialize(rows, "page-tables")).select("catalog_id", "table_idx", F.col("header_row").cast("long").alias("header_row"), F.col("product_name").cast("long").alias("product_name"), F.col("cost").cast("long").alias("cost"))


QUERIES = {
    "header_scores": header_scores, "header_fields": header_fields, "header_mapping": header_mapping, "precision_cols": precision_cols, "sheet_choice": sheet_choice, "header_rows": header_rows,
    "classified_rows": classified_rows, "parse_quality": parse_quality, "parse_records": parse_records, "parsed_products": parsed_products,
    "first_table": first_table, "dedup_names": dedup_names, "csv_rows": csv_rows, "csv_catalogs": csv_catalogs, "many_csv_products": many_csv_products, "many_csv_quality": many_csv_quality, "page_tables": page_tables, "header_warnings": header_warnings,
}


def headers_sql() -> str:
    """Scores of part_headers by field, and whether a header is left out."""
    words = ", ".join(f"('{f}', {i}, {k}, '{w}')" for i, (f, ws) in enumerate(V.COLUMN_NAMES.items()) for k, w in enumerate(dict.fromkeys(ws)))
    listed = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    ignored = " OR ".join(f"contains(norm, '{w}')" for w in V.IGNORED_COLUMNS)
    return f"""WITH h AS (SELECT CAST(p_partkey//10 AS VARCHAR) AS catalog_id, CAST(p_partkey%10 AS INTEGER) AS col_idx, CASE WHEN p_size%11=0 THEN 'Tótal  '||w WHEN p_size%5=0 THEN upper(w) WHEN p_size%5=1 THEN w||' '||p_name WHEN p_size%5=2 THEN p_name||'  '||w WHEN p_size%5=3 THEN left(w, 5) ELSE p_type END AS header
        FROM (SELECT *, {listed}[p_partkey*7%{len(WORDS)}+1] AS w FROM part)),
    v(field, field_order, k, word) AS (VALUES {words}),
    n AS (SELECT *, {squeeze(f"lower({bare('header')})")} AS norm FROM h),
    s AS (SELECT *, CASE WHEN norm=word THEN 1.0 WHEN starts_with(norm, word) AND length(word)>=4 THEN 0.88 WHEN contains(norm, word) AND length(word)>=4 THEN 0.82 WHEN contains(word, norm) AND length(norm)>=4 THEN 0.72 ELSE 0.0 END AS score FROM n, v WHERE norm<>''),
    b AS (SELECT catalog_id, col_idx, field, field_order, CAST(score AS DOUBLE) AS score, word AS keyword, ({ignored}) AS ignored FROM s WHERE score>0 QUALIFY row_number() OVER (PARTITION BY catalog_id, col_idx, field ORDER BY score DESC, k)=1),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id, col_idx ORDER BY score DESC, field_order) AS r FROM b WHERE NOT ignored) WHERE r=1 AND score>=0.6),
    m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY catalog_id, field ORDER BY score DESC, col_idx)=1)"""


def sql() -> dict[str, str]:
    h = headers_sql()
    wide = ", ".join(f"CAST(max(col_idx) FILTER (WHERE field='{f}') AS BIGINT) AS {f}" for f in V.COLUMN_NAMES)
    lost = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in ("sku", "category", "supplier"))
    tables = "WITH line AS (SELECT l_orderkey//64 AS cid, l_orderkey%64 AS t, row_number() OVER (PARTITION BY l_orderkey//64 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag) AS n, CASE WHEN l_linenumber%2=0 THEN 'LUVA ' ELSE 'Luva ' END||(l_partkey%40) AS name, l_partkey%3>0 AS sold, l_quantity>=40 AS ok FROM lineitem)"
    many = """WITH p AS (SELECT p_partkey//10 AS f, p_partkey AS k, p_name, p_brand, row_number() OVER (PARTITION BY p_partkey//10 ORDER BY p_partkey) AS i FROM part),
r AS (SELECT *, f%13=12 OR f%9=8 AS lost, k%7=0 AS unnamed, k%11=0 AS unpriced FROM p)"""
    record = ", ".join(f"{c} := {c}" for c in COUNTERS.split(", "))
    return {
        "header_scores": f"{h} SELECT catalog_id, col_idx, field, score, keyword, ignored FROM b",
        "header_fields": f"{h} SELECT catalog_id, col_idx, field, score FROM f",
        "header_mapping": f"{h} SELECT *, product_name IS NOT NULL AND cost IS NOT NULL AS has_required, concat_ws(',', {lost}) AS missing FROM (SELECT catalog_id, {wide} FROM m GROUP BY catalog_id)",
        "precision_cols": "SELECT CAST(p_partkey//10 AS VARCHAR) AS catalog_id, min(CASE WHEN p_partkey%10=8 AND p_partkey%3=0 THEN 8 END) AS query_col, min(CASE WHEN p_partkey%10 IN (3, 9) THEN p_partkey%10 END) AS model_col, min(CASE WHEN p_partkey%10=5 AND p_partkey%4<2 THEN 5 END) AS brand_col FROM part GROUP BY 1",
        "sheet_choice": f"{SHEETS} SELECT CAST(cid AS VARCHAR) AS catalog_id, CASE WHEN cid%13=0 THEN 'Configuração' ELSE 'Produtos' END AS sheet, CASE WHEN cid%13=0 THEN 1 ELSE count(*) FILTER (WHERE k<>0)+CASE WHEN cid%3=0 THEN 3 ELSE 1 END END AS n FROM sheet GROUP BY cid",
        "header_rows": f"{SHEETS} SELECT DISTINCT CAST(cid AS VARCHAR) AS catalog_id, CASE WHEN cid%13=0 THEN 0 ELSE head END AS header_row, CASE WHEN cid%13=0 OR cid%5=4 THEN 0.5 ELSE 1.0 END AS header_confidence, false AS header_warning FROM sheet",
        "classified_rows": f"{SHEETS} SELECT CAST(cid AS VARCHAR) AS catalog_id, head+n AS row_idx, reason AS skip_reason, CASE WHEN reason IS NULL THEN {NAME} END AS raw_name, CASE WHEN reason IS NULL THEN CAST(pk*7%90000+1 AS DOUBLE)/100 END AS cost, CASE WHEN reason IS NULL AND cid%5<3 THEN '00'||pk END AS sku, CASE WHEN reason IS NULL AND cid%5<3 THEN 'Forn '||sk END AS supplier FROM seen",
        "parse_quality": f"{SHEETS} SELECT CAST(cid AS VARCHAR) AS catalog_id, {COUNTERS}, success_rate, skip_rate, confidence FROM judged",
        "parse_records": f"{SHEETS} SELECT CAST(cid AS VARCHAR) AS catalog_id, CAST(to_json(struct_pack({record}, confidence := confidence)) AS VARCHAR) AS parse_metadata FROM judged",
        "parsed_products": f"{SHEETS} SELECT CAST(cid AS VARCHAR) AS catalog_id, cid||'-'||(head+n) AS product_id, {NAME} AS raw_name, CAST(pk*7%90000+1 AS DOUBLE)/100 AS cost, CASE WHEN cid%5<3 THEN '00'||pk END AS sku, category, dup AS is_dup_sku FROM good JOIN judged USING (cid) WHERE confidence<>'FAILED'",
        "first_table": f"{tables} SELECT CAST(cid AS VARCHAR) AS catalog_id, CAST(t AS INTEGER) AS table_idx, count(*) AS n FROM line JOIN (SELECT cid, min(t) AS t FROM line WHERE ok GROUP BY cid) USING (cid, t) GROUP BY cid, t",
        "dedup_names": f"{tables} SELECT CAST(cid AS VARCHAR) AS catalog_id, n AS row_idx, name AS raw_name FROM (SELECT *, row_number() OVER (PARTITION BY cid, lower(name) ORDER BY n) AS r FROM line) WHERE r=1 AND sold",
        "csv_rows": "SELECT 'Luva '||l_partkey AS raw_name, l_suppkey+0.5 AS cost, count(*) AS n FROM lineitem WHERE l_partkey%6>2 AND l_linenumber NOT IN (2, 3) GROUP BY 1, 2".replace("l_suppkey+0.5", "CAST(l_suppkey AS DOUBLE)+0.5"),
        "many_csv_products": f"{many} SELECT f||'-'||i AS product_id, p_name||CASE WHEN k%5=0 THEN ' linha, 2; \"x\" |' ELSE '' END AS raw_name, CAST(k%900+1 AS DOUBLE)+0.5 AS cost, CASE WHEN k%3<>0 THEN p_brand||' M'||k END AS normalized_name, p_brand AS supplier FROM r WHERE NOT lost AND NOT unnamed AND NOT unpriced",
        "many_csv_quality": f"{many} SELECT *, CASE WHEN success_rate>=0.8 THEN 'RELIABLE' WHEN valid_products>0 THEN 'PARTIAL' ELSE 'FAILED' END AS confidence FROM (SELECT *, coalesce(round_even(CAST(valid_products AS DOUBLE)/nullif(total_rows_scanned, 0), 4), 0.0) AS success_rate FROM (SELECT CAST(f AS VARCHAR) AS catalog_id, count(*) FILTER (WHERE NOT lost) AS total_rows_scanned, count(*) FILTER (WHERE NOT lost AND NOT unnamed AND NOT unpriced) AS valid_products, count(*) FILTER (WHERE NOT lost AND unnamed) AS skipped_invalid_name, count(*) FILTER (WHERE NOT lost AND NOT unnamed AND unpriced) AS skipped_invalid_cost FROM r GROUP BY f))",
        "header_warnings": "SELECT CAST(o_orderkey AS VARCHAR) AS catalog_id, 0 AS header_row, CASE o_orderkey%4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.1 WHEN 2 THEN 1.0 ELSE 0.4 END::DOUBLE AS header_confidence, o_orderkey%4<2 AS header_warning FROM orders",
        "page_tables": "SELECT CAST(o_orderkey//50 AS VARCHAR) AS catalog_id, CAST(o_orderkey%50 AS INTEGER) AS table_idx, CASE WHEN o_orderkey%4=1 THEN 1 ELSE 0 END AS header_row, 0 AS product_name, 1 AS cost FROM orders WHERE o_orderkey%4<3",
        "csv_catalogs": "SELECT CAST(p_partkey AS VARCHAR) AS code, p_name||' maçã, doce' AS name, p_retailprice AS price FROM part",
    }
