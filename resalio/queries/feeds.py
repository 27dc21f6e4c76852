"""Queries on feeds, texts of cells and sinks (S3 to S14, T6 to T16, K2 to K6), and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import price as P
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import market, matching, reports
from ..operators.ordering import numbered
from ..oracles import TO_LISTINGS, cents, listed, norm, tokens
from ..sources import driver, feeds, markup, sinks
from ..sources.shared import new_folder

KEY = ["l_linenumber", "l_partkey", "l_suppkey", *driver.LINE[2:]]


def text(c) -> Column:
    return F.col(c).cast("string")


def feed(spark: SparkSession, d: str, item) -> DataFrame:
    """An order's lines, in order, as one JSON array of items."""
    lines = F.array_sort(F.collect_list(F.struct(*KEY)))  # some seven an order
    orders = driver.read(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    return orders.select(F.concat(F.lit("q"), text("l_orderkey")).alias("query"), F.to_json(F.transform("lines", item)).alias("json"))


def api_item(x: Column) -> Column:
    price = F.when(x.l_discount == 0, F.lit(0)).otherwise(x.l_partkey * 10 + 5).cast("decimal(15,0)") * F.lit("0.001").cast("decimal(4,3)")
    return F.struct(
        F.when(x.l_quantity % 13 == 0, "").otherwise(F.concat(F.lit("MLB"), x.l_partkey.cast("string"))).alias("id"), F.when(x.l_quantity % 7 == 0, "  ").otherwise(F.concat(F.lit(" Luva "), x.l_partkey.cast("string"))).alias("title"),
        price.alias("price"), F.when(x.l_linenumber % 2 == 1, (x.l_quantity * 10).cast("long")).alias("sold_quantity"), F.lit("gold_special").alias("listing_type_id"), F.when(x.l_suppkey % 3 > 0, F.struct(x.l_suppkey.alias("id"))).alias("seller"),
    )


def actor_item(x: Column) -> Column:
    c, k = x.l_partkey * 37 + 100, x.l_partkey % 3
    whole, rest = F.floor(c / 100), F.lpad((c % 100).cast("string"), 2, "0")
    brazil = F.concat(F.lit("R$ "), F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string")), F.lit(","), rest)
    price = F.when(x.l_linenumber == 7, "grátis").when(k == 0, brazil).when(k == 1, F.concat(whole.cast("string"), F.lit("."), rest)).otherwise(F.concat((x.l_partkey % 9 + 1).cast("string"), F.lit("."), F.lpad((x.l_partkey % 1000).cast("string"), 3, "0")))
    link = F.when(x.l_partkey % 5 == 0, "https://p/sem-id").otherwise(F.concat(F.lit("https://p/mlb-"), x.l_partkey.cast("string"), F.lit("-luva")))
    return F.struct(F.concat(F.lit(" Luva "), x.l_partkey.cast("string")).alias("eTituloProduto"), F.when(x.l_partkey % 2 == 1, F.concat(F.lit("S"), x.l_partkey.cast("string"))).alias("SKU"), price.alias("novoPreco"), link.alias("zProdutoLink"))


def api_listings(spark: SparkSession, d: str) -> DataFrame:
    out = feeds.parse_api_listings(feed(spark, d, api_item))
    return out.select("query", "position", "item_id", "title", F.col("price").cast("double").alias("price"), "sold_quantity", "seller_id", "listing_type", "category_id")


def actor_listings(spark: SparkSession, d: str) -> DataFrame:
    out = feeds.parse_actor_listings(feed(spark, d, actor_item))
    return out.select("query", "position", "item_id", "title", F.col("price").cast("double").alias("price"), "sold_quantity", "seller_id", "permalink")


def listing_cards(spark: SparkSession, d: str) -> DataFrame:
    """Pages with six cards after what they hold: nested tags and entities; single quotes, no quotes and capitals; one without an item; older markup with a card within a card; and cards in a comment and a script, which are none."""
    i = text("page_id")
    now = F.concat(F.lit('<li class="a ui-search-layout__item b"><div><a data-x="a>b" class="ui-search-link x" href="https://x/MLB-'), i, F.lit('-y?a=1&amp;b=2"><h2 class="poly-component__title"> Luva <b>'), i, F.lit('</b> &amp; <i>p&atilde;o</i></h2></a><span class="andes-money-amount__fraction">1.'), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"), F.lit('</span><br><span class="poly-component__sold-title">+'), (F.col("page_id") % 9 + 1).cast("string"), F.lit(" mil vendidos</span></div></li>"))
    single = F.concat(F.lit("<!-- <li class='ui-search-layout__item'><a class='ui-search-link' href='MLB-1'>x</a></li> --><script>var t = \"<li class='ui-search-layout__item'>\";</script><LI CLASS='ui-search-layout__item'><A CLASS=poly-component__title HREF=https://x/mlb7"), i, F.lit(">Bola</A><p>unclosed<span class='qty-sold big'>5 vendidos</LI>"))
    none = F.lit('<li class="ui-search-layout__item"><a class="ui-search-link" href="https://x/nada"><h2 class="poly-component__title">Luva</h2></a></li><li class="ui-search-layout__item"><a href="https://x/MLB5">Luva</a></li>')
    old = F.concat(F.lit('<li class="ui-search-layout__item"><a href="https://www.mercadolivre.com/MLB9'), i, F.lit('"><h2 class="ui-search-item__title">Bota</h2></a><ul><li class="x">y</li></ul><span class="price-tag-fraction">99</span></li>'))
    pages = driver.read(spark, d, "pages").select(i.alias("query"), F.concat("html", F.lit("<ol>"), now, single, none, old, F.lit("</ol>")).alias("html"))
    return markup.extract_listing_cards(pages).select("query", "position", "item_id", "title", F.col("price").cast("double").alias("price"), "sold_quantity", "permalink")


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """T15 and T10 on the html of pages: titles read from their markup, as slugs and as searches."""
    found = markup.page_outlines(driver.read(spark, d, "pages"))
    return found.select("page_id", "title", T.query_slug("title").alias("slug"))


def joined_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The actor's feed before the API's where it is there; both in one schema."""
    api, actor = feeds.parse_api_listings(feed(spark, d, api_item)), feeds.parse_actor_listings(feed(spark, d, actor_item))
    first = market.choose_feed(None, api, actor).groupBy("query").agg(F.count("*").alias("n_first"))
    both = matching.to_listings(api, actor).groupBy("query").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("value"))
    return both.join(first, "query", "left").select("query", "n", "value", F.coalesce("n_first", F.lit(0)).alias("n_first"))


def written_products(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "products")
    sinks.write_products(driver.products(spark, d).select("product_id", "catalog_id", "raw_name"), folder)
    return spark.read.parquet(folder).select("product_id", "catalog_id", "raw_name")


def products_of(spark: SparkSession, d: str) -> DataFrame:
    return reports.products_of(driver.products(spark, d), "Brand#7").select("product_id", "raw_name")


def written_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Products written by catalog; a report on one catalog reads its folder alone."""
    folder = new_folder(spark, "products")
    sinks.write_products(driver.products(spark, d).repartition("catalog_id"), folder)
    return reports.products_of(spark.read.parquet(folder), "Brand#7").select("product_id", "raw_name", F.col("cost").cast("double").alias("cost"))


def migrated(spark: SparkSession, d: str) -> DataFrame:
    old = F.when(F.col("o_orderpriority").startswith("1"), "ALTA").when(F.col("o_orderpriority").startswith("2"), "MEDIA").when(F.col("o_orderpriority").startswith("3"), "BAIXA").otherwise("EVITAR")
    return driver.read(spark, d, "orders").select("o_orderkey", old.alias("recommendation")).select("o_orderkey", sinks.migrate_recommendation().alias("recommendation"))


def named_products(spark: SparkSession, d: str) -> DataFrame:
    """Three quarters of the parts get names from answers of 50 in which names are blank or missing, the last three of each always."""
    p = driver.products(spark, d).withColumn("normalized_name", F.when(F.col("product_id") % 4 == 0, "Pronto"))
    unnamed = numbered(p.filter("normalized_name IS NULL").select("catalog_id", "product_id"), ["catalog_id"], [F.col("product_id")], "i").withColumn("i", F.col("i") - 1)
    name = F.when(F.col("product_id") % 5 == 0, " ").when(F.col("product_id") % 5 > 1, F.concat(F.lit("Nome "), text("product_id")))
    rows = unnamed.groupBy("catalog_id", F.floor(F.col("i") / 50).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("i", name.alias("name")))).alias("rows"))  # 50
    answers = rows.select("catalog_id", "batch", F.to_json(F.slice(F.col("rows.name"), 1, 47), {"ignoreNullFields": "false"}).alias("json"))
    out = feeds.apply_name_batches(p, answers)
    return out.select("product_id", "normalized_name", T.search_name("normalized_name", "raw_name").alias("search_name"))


def cell_texts(spark: SparkSession, d: str) -> DataFrame:
    """T6 to T8, T11 to T13, T16, P2 on cells made of parts."""
    p, k, s = driver.read(spark, d, "part"), F.col("p_partkey"), F.col("p_size") % 6
    raw = F.when(s == 0, F.concat(F.lit("  a\t"), "p_name", F.lit("\n c "))).when(s == 1, " NaN ").when(s == 2, "-").when(s == 3, "#REF!").when(s == 4, F.concat_ws("  ", "p_type", "p_name"))
    sku = F.when(k % 3 == 0, F.concat(text("p_partkey"), F.lit(".0"))).when(k % 3 == 1, F.concat(F.lit("00"), text("p_partkey"))).otherwise(F.concat(text("p_partkey"), F.lit(".50")))
    coded = F.concat(F.when(s == 0, "10001 - ").when(s == 1, "A-045 ").when(s == 2, "REF: X ").when(s == 3, "99999 ").otherwise(""), "p_name")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://p/MLB-"), text("p_partkey"), F.lit("-x"))).otherwise(F.concat(F.lit("https://p/"), text("p_partkey")))
    words = F.concat_ws(" ", "p_name", "p_type", F.when(k % 2 == 0, F.lit("extra")))
    query, brand, model = F.when(s == 0, " q ").when(s == 1, "nan"), F.when(k % 2 == 0, F.col("p_brand")), F.when(k % 3 == 0, " m1 ").when(k % 3 == 1, "None")
    way = F.when(s == 0, "fulfillment").when(s == 1, "drop_off").when(s == 2, "self_service").when(s == 3, "xd_drop_off").otherwise("other")
    status = F.when(s == 0, "PENDING").when(s == 1, "PARSING").when(s == 2, "RESEARCHING").when(s == 3, "READY").when(s == 4, "ERROR").otherwise("?")
    money = (k * k * 7 - 5000) * F.lit("0.01").cast("decimal(3,2)")
    return p.select(
        "p_partkey", T.clean_text(raw).alias("cell"), T.clean_sku(sku, k % 2 == 0).alias("sku"), T.without_code(coded).alias("name"), T.item_id(url).alias("item_id"), T.simplify_query(words).alias("query"),
        T.precision_name(query, brand, model).alias("precise"), T.logistic_label(way).alias("way"), T.status_label(status).alias("status"), T.format_brl(F.abs(money)).alias("brl"), T.format_pct(F.col("p_size") / 4).alias("pct"), P.is_valid_cost(money).alias("valid"),
    )


def distinct_queries(spark: SparkSession, d: str) -> DataFrame:
    p = driver.products(spark, d).withColumn("query", F.when(F.col("product_id") % 9 == 0, " ").otherwise(F.concat_ws(" ", "category", (F.col("product_id") % 400).cast("string"))))
    return market.distinct_queries(p)


def query_batches(spark: SparkSession, d: str) -> DataFrame:
    return market.batch_id(driver.products(spark, d).select("product_id", "catalog_id"), "product_id")


def assembled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of queries, three a query, some short."""
    o = driver.read(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 3).alias("query"), (F.col("o_orderkey") % 3).alias("page"), F.array_repeat(F.lit(1), F.when(F.col("o_custkey") % 2 == 0, 50).otherwise(20)).alias("results"))
    return market.assemble_pages(o).select("query", "page", F.size("results").cast("long").alias("n"))


def order_listings(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as the listings of one page."""
    by = Window.partitionBy("l_orderkey").orderBy(*KEY)  # some seven rows
    none = F.lit("").alias
    return driver.read(spark, d, "lineitem").withColumn("position", F.row_number().over(by)).select(
        F.col("l_orderkey").alias("product_id"), "position", F.concat_ws("-", text("l_orderkey"), text("position")).alias("item_id"), F.col("l_quantity").cast("long").alias("sold_quantity"), F.lit(0).cast("long").alias("seller_id"),
        F.lit(False).alias("free_shipping"), none("condition"), none("listing_type"), none("category_id"), none("logistic_type"), (F.col("l_partkey") * F.lit("0.50").cast("decimal(3,2)")).cast(P.MONEY).alias("price"), F.col("l_suppkey").alias("s"),
    )


def enriched_pages(spark: SparkSession, d: str) -> DataFrame:
    given = order_listings(spark, d)
    details = given.filter("s % 3 > 0").select("item_id", (F.col("s") * 2).alias("d_sold"), F.lit("new").alias("d_condition"), F.lit("gold").alias("d_listing_type"), F.col("s").alias("d_seller_id"), F.lit(True).alias("d_free_shipping"), F.lit("full").alias("d_logistic_type"), F.lit("c").alias("d_category_id"), (F.col("price") + 1).cast(P.MONEY).alias("d_price"))
    out = market.enrich_pages(given, details)
    return out.select("product_id", F.col("position").cast("long").alias("position"), "item_id", "sold_quantity", F.col("price").cast("double").alias("price"), "condition", "free_shipping", "seller_id")


def listing_fees(spark: SparkSession, d: str) -> DataFrame:
    """K6: the first three listings of a page ask for the fee of their category and price band."""
    given = order_listings(spark, d).withColumns({"__head": F.col("position") <= 3, "category_id": F.when(F.col("s") % 4 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("s") % 4).cast("string"))), "ml_fee_pct": F.lit("9.50").cast("decimal(5,2)")})
    band = lambda c, a, b, pct: F.struct(F.lit(c).alias("category_id"), F.lit(a).cast(P.MONEY).alias("price_from"), F.lit(b).cast(P.MONEY).alias("price_to"), F.lit(pct).cast("decimal(5,2)").alias("fee_pct"))
    fees = spark.range(1).select(F.inline(F.array(*[band(f"c{k}", a, b, pct + k) for k in (1, 2) for a, b, pct in ((0, 79, 12), (79, 10**9, 16))])))
    return market.lookup_fee(given, fees).select("item_id", F.col("ml_fee_pct").cast("double").alias("fee"))


def plural_tokens(spark: SparkSession, d: str) -> DataFrame:
    """T4, T5 on names that begin with a plural of a word that weighs, of one that doesn't, or of a short one."""
    words = [w for w in V.HIGH_WEIGHT if w.isascii() and w.isalpha()]
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % len(words) + 1).cast("int"))
    name = F.concat(word, F.when(F.col("p_size") % 4 == 0, F.lit("ss")).otherwise(F.lit("s")), F.lit(" "), F.col("p_name"), F.lit("s "), F.col("p_size").cast("string"))
    return driver.read(spark, d, "part").select("p_partkey", F.array_join(T.tokens(name), " ").alias("tokens"))


def banded_fees(spark: SparkSession, d: str) -> DataFrame:
    """K6 with a schedule made of parts: a band of prices a part in four categories, with gaps; all listings ask."""
    given = driver.listings(spark, d).withColumns({"__head": F.lit(True), "category_id": F.concat(F.lit("c"), (F.col("seller_id") % 4).cast("string"))})
    k = F.floor(F.col("p_partkey") / 4)
    reais = lambda c: c.cast(P.MONEY)
    fees = driver.read(spark, d, "part").select(F.concat(F.lit("c"), (F.col("p_partkey") % 4).cast("string")).alias("category_id"), reais(k * 40).alias("price_from"), reais(k * 40 + 32).alias("price_to"), (k % 20 + F.lit("0.5").cast("decimal(2,1)")).cast("decimal(5,2)").alias("fee_pct"))
    return market.lookup_fee(given, fees).groupBy("item_id", F.col("price").cast("double").alias("price")).agg(F.max(F.col("ml_fee_pct").cast("double")).alias("fee"), F.count("*").alias("n"))


QUERIES = {
    "api_listings": api_listings, "actor_listings": actor_listings, "listing_cards": listing_cards, "page_titles": page_titles, "joined_feeds": joined_feeds, "written_products": written_products, "products_of": products_of, "written_catalog": written_catalog, "migrated_classes": migrated,
    "named_products": named_products, "cell_texts": cell_texts, "distinct_queries": distinct_queries, "query_batches": query_batches, "assembled_pages": assembled_pages, "enriched_pages": enriched_pages, "listing_fees": listing_fees, "banded_fees": banded_fees, "plural_tokens": plural_tokens,
}

ORDER = f"PARTITION BY l_orderkey ORDER BY {', '.join(KEY)}"
API = f"api AS (SELECT 'q'||l_orderkey AS query, position, 'MLB'||l_partkey AS item_id, 'Luva '||l_partkey AS title, l_partkey+l_partkey%2 AS price_c, CASE WHEN l_linenumber%2=1 THEN CAST(l_quantity*10 AS BIGINT) ELSE 0 END AS sold_quantity, CASE WHEN l_suppkey%3>0 THEN l_suppkey ELSE 0 END AS seller_id FROM x WHERE l_quantity%13<>0 AND l_quantity%7<>0 AND l_discount<>0)"
ACTOR = """actor AS (SELECT 'q'||l_orderkey AS query, position, CASE WHEN l_partkey%2=1 THEN 'S'||l_partkey WHEN l_partkey%5=0 THEN '' ELSE 'MLB'||l_partkey END AS item_id, 'Luva '||l_partkey AS title,
    CASE WHEN l_partkey%3<2 THEN l_partkey*37+100 ELSE CAST(round_even(((l_partkey%9+1)*1000+l_partkey%1000)/10.0, 0) AS BIGINT) END AS price_c, CASE WHEN l_partkey%5=0 THEN 'https://p/sem-id' ELSE 'https://p/mlb-'||l_partkey||'-luva' END AS permalink FROM x WHERE l_linenumber<>7)"""
PLACED = f"WITH x AS (SELECT *, CAST(row_number() OVER ({ORDER}) AS INTEGER) AS position FROM lineitem)"


def sql() -> dict[str, str]:
    clean = "CASE p_size%6 WHEN 0 THEN 'a '||p_name||' c' WHEN 4 THEN p_type||' '||p_name END"
    words = "p_name||' '||p_type||CASE WHEN p_partkey%2=0 THEN ' extra' ELSE '' END"
    money = "abs(p_partkey*p_partkey*7-5000)"
    grouped = f"regexp_replace(reverse(regexp_replace(reverse(CAST({money}//100 AS VARCHAR)), '(\\d{{3}})', '\\1.', 'g')), '^\\.', '')"
    return {
        "api_listings": f"{PLACED}, {API} SELECT query, position, item_id, title, {cents('price_c', 'price')}, sold_quantity, seller_id, 'gold_special' AS listing_type, '' AS category_id FROM api",
        "actor_listings": f"{PLACED}, {ACTOR} SELECT query, position, item_id, title, {cents('price_c', 'price')}, 0 AS sold_quantity, 0 AS seller_id, permalink FROM actor",
        "listing_cards": """SELECT CAST(page_id AS VARCHAR) AS query, 1 AS position, 'MLB'||page_id AS item_id, 'Luva'||page_id||'&pão' AS title, CAST(1000+page_id%1000 AS DOUBLE) AS price, (page_id%9+1)*1000 AS sold_quantity, 'https://x/MLB-'||page_id||'-y?a=1&b=2' AS permalink FROM pages
            UNION ALL SELECT CAST(page_id AS VARCHAR), 2, 'MLB7'||page_id, 'Bola', 0.0, 5, 'https://x/mlb7'||page_id FROM pages
            UNION ALL SELECT CAST(page_id AS VARCHAR), 5, 'MLB9'||page_id, 'Bota', 99.0, 0, 'https://www.mercadolivre.com/MLB9'||page_id FROM pages""",
        "page_titles": """SELECT page_id, title, regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^\\pL\\pN_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
            FROM (SELECT page_id, trim(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '"'), '&amp;', '&')) AS title FROM pages)""",
        "joined_feeds": f"{PLACED}, {API}, {ACTOR} SELECT query, n, value, coalesce(n_first, 0) AS n_first FROM (SELECT query, count(*) AS n, CAST(sum(price_c) AS DOUBLE)/100 AS value FROM (SELECT query, price_c FROM api UNION ALL SELECT query, price_c FROM actor) GROUP BY query) LEFT JOIN (SELECT query, count(*) AS n_first FROM api GROUP BY query) USING (query)",
        "written_products": "SELECT p_partkey AS product_id, p_brand AS catalog_id, p_name||' CX'||p_size AS raw_name FROM part",
        "written_catalog": "SELECT p_partkey AS product_id, p_name||' CX'||p_size AS raw_name, round(p_retailprice, 2) AS cost FROM part WHERE p_brand='Brand#7'",
        "products_of": "SELECT p_partkey AS product_id, p_name||' CX'||p_size AS raw_name FROM part WHERE p_brand='Brand#7'",
        "migrated_classes": "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'EXCELENTE' WHEN '2' THEN 'BOA' WHEN '3' THEN 'ARRISCADA' ELSE 'EVITAR' END AS recommendation FROM orders",
        "named_products": """SELECT product_id, name AS normalized_name, coalesce(name, raw_name) AS search_name FROM (SELECT product_id, raw_name, CASE WHEN product_id%4=0 THEN 'Pronto' WHEN product_id%5>1 AND i%50<47 AND (i%50<=n-i//50*50-1) THEN 'Nome '||product_id END AS name
            FROM (SELECT p_partkey AS product_id, p_name||' CX'||p_size AS raw_name, row_number() OVER (PARTITION BY p_brand, p_partkey%4=0 ORDER BY p_partkey)-1 AS i, count(*) OVER (PARTITION BY p_brand, p_partkey%4=0) AS n FROM part))""",
        "cell_texts": f"""SELECT p_partkey, {clean} AS cell, CASE WHEN p_partkey%3=0 THEN CASE WHEN p_partkey%2=0 THEN CAST(p_partkey AS VARCHAR) ELSE p_partkey||'.0' END WHEN p_partkey%3=1 THEN '00'||p_partkey ELSE p_partkey||'.50' END AS sku, p_name AS name,
            CASE WHEN p_partkey%2=0 THEN 'MLB'||p_partkey END AS item_id, array_to_string(list_slice(string_split({words}, ' '), 1, 3), ' ') AS query,
            CASE WHEN p_size%6=0 THEN 'q' WHEN p_partkey%3=0 THEN CASE WHEN p_partkey%2=0 THEN p_brand||' ' ELSE '' END||'m1' END AS precise, CASE p_size%6 WHEN 0 THEN 'Full' WHEN 1 THEN 'Flex' WHEN 2 THEN 'Proprio' WHEN 3 THEN 'XD' ELSE 'other' END AS way,
            CASE p_size%6 WHEN 0 THEN 'Na fila' WHEN 1 THEN 'Lendo arquivo' WHEN 2 THEN 'Pesquisando ML' WHEN 3 THEN 'Pronto' WHEN 4 THEN 'Erro' ELSE '?' END AS status,
            'R$ '||{grouped}||','||lpad(CAST({money}%100 AS VARCHAR), 2, '0') AS brl, ((p_size*10+2)//4)//10||','||((p_size*10+2)//4)%10||'%' AS pct, p_partkey*p_partkey*7-5000 BETWEEN 1 AND 99999900 AS valid FROM part""",
        "distinct_queries": "SELECT DISTINCT p_type||' '||(p_partkey%400) AS query FROM part WHERE p_partkey%9<>0",
        "query_batches": "SELECT p_partkey AS product_id, p_brand AS catalog_id, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)-1)//40 AS INTEGER) AS batch_id FROM part",
        "assembled_pages": "SELECT query, page, n FROM (SELECT *, min(CASE WHEN n<50 THEN page END) OVER (PARTITION BY query) AS short FROM (SELECT o_orderkey//3 AS query, o_orderkey%3 AS page, CASE WHEN o_custkey%2=0 THEN 50 ELSE 20 END AS n FROM orders)) WHERE page<2 AND (short IS NULL OR page<=short)",
        "enriched_pages": f"""{PLACED}, y AS (SELECT *, l_suppkey%3>0 AS known, position<=5 AND l_suppkey%3=0 AS miss FROM x), z AS (SELECT *, miss AND coalesce(lag(miss) OVER ({ORDER}), false) AS two FROM y),
            w AS (SELECT *, known AND position<=5 AND NOT coalesce(max(two) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit FROM z),
            v AS (SELECT l_orderkey AS product_id, position, l_orderkey||'-'||position AS item_id, CASE WHEN hit THEN l_suppkey*2 ELSE CAST(l_quantity AS BIGINT) END AS sold_quantity, l_partkey*0.5+CASE WHEN hit THEN 1 ELSE 0 END AS price, CASE WHEN hit THEN 'new' ELSE '' END AS condition, hit AS free_shipping, CASE WHEN hit THEN l_suppkey ELSE 0 END AS seller_id FROM w)
            SELECT * REPLACE (row_number() OVER (PARTITION BY product_id ORDER BY sold_quantity DESC, position) AS position, CAST(price AS DOUBLE) AS price) FROM v""",
        "plural_tokens": f"SELECT p_partkey, array_to_string({tokens('n')}, ' ') AS tokens FROM (SELECT p_partkey, {norm('x')} AS n FROM (SELECT p_partkey, {listed(w for w in V.HIGH_WEIGHT if w.isascii() and w.isalpha())}[p_partkey%{len([w for w in V.HIGH_WEIGHT if w.isascii() and w.isalpha()])}+1]||CASE WHEN p_size%4=0 THEN 'ss' ELSE 's' END||' '||p_name||'s '||p_size AS x FROM part))",
        "banded_fees": f"{TO_LISTINGS} SELECT item_id, CAST(price_c AS DOUBLE)/100 AS price, max(CASE WHEN price_c%4000<3200 THEN CAST(price_c//4000%20 AS DOUBLE)+0.5 END) FILTER (WHERE p_partkey IS NOT NULL) AS fee, count(*) AS n FROM l LEFT JOIN part ON p_partkey=price_c//4000*4+seller_id%4 GROUP BY item_id, price_c",
        "listing_fees": f"{PLACED} SELECT l_orderkey||'-'||position AS item_id, CASE WHEN position<=3 AND l_suppkey%4>0 AND l_partkey>0 THEN CASE WHEN l_suppkey%4<3 THEN l_suppkey%4+CASE WHEN l_partkey*0.5<79 THEN 12.0 ELSE 16.0 END END ELSE 9.5 END AS fee FROM x".replace("END AS fee", "END::DOUBLE AS fee"),
    }
