"""Queries on whole runs, spread data and reports (K10, F9, F12, C1 to C8, Q2 to Q16, I1 to I4, S11, S12), and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracles as O
from ..functions.price import MONEY
from ..operators import finance, market, reports
from ..plans import catalogs
from ..sources import driver, sinks
from ..sources.shared import Run, materialize, new_folder
from ..streaming import catalogs as streaming
from . import sheets


def spread(spark: SparkSession, d: str) -> catalogs.Analysis:
    """An analysis with costs, prices, sales and matches of every class: prices of 0, no sales, unsure matches, costs that don't pay."""
    k = F.col("product_id")
    p = driver.products(spark, d).withColumn("cost", (F.col("cost") * (k % 60 + 1)).cast(MONEY))
    given = driver.listings(spark, d)
    sold = F.when(k % 6 == 0, F.lit(0)).otherwise(F.col("sold_quantity") * (k % 41) / 20)
    given = given.withColumns({"price": F.when(k % 50 == 0, F.lit(0)).otherwise(F.col("price")).cast(MONEY), "sold_quantity": F.floor(sold).cast("long"), "match_score": (F.col("seller_id") % 10 * (k % 2) + 1) / 10, "seller_id": F.col("seller_id") % (k % 37 + 1)})
    return catalogs.analyze(p, given)


def doubled(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def scores_spread(spark: SparkSession, d: str) -> DataFrame:
    return doubled(spread(spark, d).scores.select("product_id", "catalog_id", "demand_score", "margin_score", "competition_score", "confidence_score", "final_score", "recommendation", "rank_position", "explanation", "avg_match_confidence"))


def finance_spread(spark: SparkSession, d: str) -> DataFrame:
    cols = ["product_id", "cost", "avg_market_price", "ml_fee", "gross_margin", "gross_margin_pct", "break_even_price", "price_safety_margin_pct", "net_margin", "net_margin_pct", "is_viable", "min_price_for_target_margin"]
    return doubled(spread(spark, d).finance.select(*cols, finance.finance_summary().alias("summary")))


def hard_finance(spark: SparkSession, d: str) -> DataFrame:
    """F11 on products of every fault among good ones: no cost, a cost of 0, costs that prices of a real can't bear, a market row without a price."""
    k = F.col("product_id")
    hard = k % 13 == 0
    p = driver.products(spark, d).withColumns({"cost": F.when(k % 11 == 0, F.lit(None)).when(hard, F.lit("999999.00")).when(k % 17 == 0, F.lit(0)).otherwise(F.col("cost")).cast(MONEY), "raw_name": F.when(hard, F.lit("Luva")).otherwise(F.col("raw_name"))})
    m = market.market_analysis(driver.listings(spark, d))
    price = F.when(hard & (k % 2 == 0), F.lit("0.99")).when(hard, F.lit("10.00")).when(k % 19 == 0, F.lit(None)).otherwise(F.col("avg_price"))
    return materialize(finance.attempt(p, m.withColumn("avg_price", price.cast(MONEY))), "attempted")


def finance_isolated(spark: SparkSession, d: str) -> DataFrame:
    """The results of the good products."""
    return doubled(finance.results(hard_finance(spark, d)).select("product_id", "cost", "avg_market_price", "gross_margin_pct", "net_margin", "net_margin_pct", "is_viable", "min_price_for_target_margin"))


def finance_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """The other products, with reasons and fields."""
    return doubled(finance.quarantine(hard_finance(spark, d)).select("product_id", "catalog_id", "cost", "avg_price", "reason", F.array_join("fields", ",").alias("fields")))


def finance_default(spark: SparkSession, d: str) -> DataFrame:
    """F1's defaults: a fee of 15 %, no shipping, no tax; gross margins decide."""
    given = market.market_analysis(driver.listings(spark, d)).withColumns({"avg_ml_fee_pct": F.lit(None).cast("decimal(5,2)"), "free_shipping_pct": F.lit(0).cast("decimal(5,2)")})
    return doubled(finance.analyze(driver.products(spark, d), given, finance.FeeConfig()).select("product_id", "ml_fee", "gross_margin", "gross_margin_pct", "break_even_price", "price_safety_margin_pct", "net_margin", "net_margin_pct", "is_viable", "min_price_for_target_margin"))


def price_skew(spark: SparkSession, d: str) -> DataFrame:
    return market.market_analysis(driver.listings(spark, d)).select("product_id", "price_skewed")


def joined(spark: SparkSession, d: str) -> DataFrame:
    a = spread(spark, d)
    own = ["product_id", "final_score", "rank_position", "recommendation", "explanation"]
    return reports.opportunities(a.products, a.scores.select(*own, "catalog_id"), a.market, a.finance)


def opportunities_good(spark: SparkSession, d: str) -> DataFrame:
    a = spread(spark, d)
    out = reports.opportunities(a.products, a.scores.select("product_id", "catalog_id", "final_score", "rank_position", "recommendation"), a.market, a.finance, recommendation="BOA", min_score=60)
    return doubled(out.select("product_id", "catalog_id", "final_score", "rank_position", "recommendation", "avg_price", "is_viable"))


def filtered_excellent(spark: SparkSession, d: str) -> DataFrame:
    a = spread(spark, d)
    return doubled(reports.opportunity_filter(a.scores, a.market, a.finance, reports.OpportunityFilter.only_excellent()).select("product_id", "final_score", "gross_margin_pct"))


def filtered_any(spark: SparkSession, d: str) -> DataFrame:
    a = spread(spark, d)
    f = reports.OpportunityFilter(min_final_score=30, min_margin_pct=-5, min_demand_listings=25, only_viable=False)
    return doubled(reports.opportunity_filter(a.scores, a.market, a.finance, f).select("product_id", "final_score", "gross_margin_pct"))


def listings_of(spark: SparkSession, d: str) -> DataFrame:
    return reports.listings_of(market.top_listings(driver.listings(spark, d, True)), 7).select("product_id", F.col("rank_position").cast("long").alias("rank_position"), "item_id")


def ranked_scores(spark: SparkSession, d: str) -> DataFrame:
    return reports.ranked_scores(reports.by_rank(spread(spark, d).scores), "Brand#7").select("product_id", "rank_position")


def catalogs_of(spark: SparkSession, d: str) -> DataFrame:
    c = driver.read(spark, d, "orders").select(F.col("o_orderkey").alias("catalog_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    return reports.catalogs_of(c, 5, 4).select("catalog_id", "user_id")


def page(spark: SparkSession, d: str) -> DataFrame:
    return reports.page(driver.products(spark, d), "product_id", offset=100, limit=50).select("product_id", "raw_name")


def sample_products(spark: SparkSession, d: str) -> DataFrame:
    s = reports.sample_products(joined(spark, d))
    return s.select("product_id", "raw_name", F.col("market.total_listings_found").alias("listings"), F.col("finance.gross_margin_pct").cast("double").alias("gross_margin_pct"), F.col("score.rank_position").cast("long").alias("rank_position"), F.col("score.recommendation").alias("recommendation"))


def status_of(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in (*reports.PROGRESS, "ERROR")]), (c % 7 + 1).cast("int"))


def stage_progress(spark: SparkSession, d: str) -> DataFrame:
    o = driver.read(spark, d, "orders").select("o_orderkey", status_of(F.col("o_orderkey")).alias("status"), F.col("o_custkey").alias("total_products"))
    done, left = reports.stage_progress()
    return o.select("o_orderkey", done.cast("long").alias("done"), left.cast("long").alias("minutes_left"))


def latest_status(spark: SparkSession, d: str) -> DataFrame:
    e = driver.read(spark, d, "events").select(F.col("user_id").alias("catalog_id"), F.col("event_type").alias("status"), F.col("ts"))
    return catalogs.latest_status(e).select("catalog_id", "status", "changes")


def cleared(spark: SparkSession, d: str) -> DataFrame:
    a = spread(spark, d)
    return sinks.clear_derived(a.scores.select("product_id", "rank_position"), a.products, "Brand#3")


def backfilled(spark: SparkSession, d: str) -> DataFrame:
    f = spread(spark, d).finance.select("product_id", "avg_market_price", F.col("ml_fee_pct").alias("marketplace_fee_pct"), F.when(F.col("product_id") % 3 == 0, F.lit(0).cast(MONEY)).otherwise(F.col("ml_fee") + 1).cast(MONEY).alias("ml_fee"))
    return doubled(sinks.backfill_ml_fee(f).select("product_id", "ml_fee"))


def rerun(spark: SparkSession, d: str) -> DataFrame:
    """Market rows of over 30 listings are kept, at another price; the others are worked out."""
    given = driver.listings(spark, d)
    kept = market.market_analysis(given).filter("total_listings_found > 30").withColumn("avg_price", (F.col("avg_price") + 1000).cast(MONEY))
    a = catalogs.rerun_analysis(driver.products(spark, d), given, materialize(kept, "kept"))
    return doubled(a.scores.select("product_id", "avg_market_price", "gross_margin_pct", "final_score", "rank_position"))


def full_run(spark: SparkSession, d: str) -> DataFrame:
    """Sheets are parsed, matched with two listings a part, analysed and ranked."""
    part = driver.read(spark, d, "part")
    name = F.concat(F.lit("luva x"), F.translate(F.col("p_partkey").cast("string"), *sheets.LETTERS))
    one = part.select(
        name.alias("query"), F.col("p_partkey").cast("string").alias("item_id"), F.concat(name, F.lit(" azul")).alias("title"), (F.round(F.col("p_retailprice") * 100).cast("long") * 2 * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY).alias("price"),
        (F.col("p_size") * 1000).cast("long").alias("sold_quantity"), F.col("p_partkey").alias("seller_id"), (F.col("p_size") % 2 == 0).alias("free_shipping"), F.lit(None).cast("decimal(5,2)").alias("ml_fee_pct"), F.lit(1).alias("position"),
    )
    two = one.withColumns({"title": F.concat(F.lit("Kit 10 "), "title"), "position": F.lit(2), "item_id": F.concat(F.lit("k"), "item_id")})
    _, a = catalogs.run_pipeline(sheets.raw_sheets(spark, d), one.unionByName(two), min_confidence=0.0)
    return doubled(a.scores.select("product_id", "catalog_id", "cost", "avg_market_price", "net_margin_pct", "confidence_score", "final_score", "rank_position", "is_viable"))


def resumed_run(spark: SparkSession, d: str) -> DataFrame:
    """I1 started twice: the second start has no listings, and reads what the first has made of them."""
    run, p = Run(spark), driver.products(spark, d)
    run.stage("market", lambda: market.market_analysis(driver.listings(spark, d)))
    a = catalogs.analyze(p, driver.listings(spark, d).limit(0), run=run)
    return doubled(a.scores.select("product_id", "catalog_id", "avg_market_price", "final_score", "rank_position", "recommendation"))


def streamed_market(spark: SparkSession, d: str) -> DataFrame:
    """Listings in files, a product's in several, streamed file by file into market rows."""
    folder = new_folder(spark, "stream")
    given = driver.listings(spark, d)
    given.repartition(3).write.parquet(f"{folder}/in")
    schema = ", ".join(f"{c} {t}" for c, t in given.dtypes)
    streaming.stream_market(spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/checkpoint", files=2, buckets=4).awaitTermination()
    return doubled(streaming.read_market(spark, f"{folder}/out").select("product_id", "avg_price", "total_listings_found", "total_sold_quantity"))


QUERIES = {
    "scores_spread": scores_spread, "finance_spread": finance_spread, "finance_isolated": finance_isolated, "finance_quarantine": finance_quarantine, "finance_default": finance_default, "price_skew": price_skew, "opportunities_good": opportunities_good, "filtered_excellent": filtered_excellent, "filtered_any": filtered_any, "listings_of": listings_of, "ranked_scores": ranked_scores,
    "catalogs_of": catalogs_of, "page": page, "sample_products": sample_products, "stage_progress": stage_progress, "latest_status": latest_status, "cleared_scores": cleared, "backfilled_fees": backfilled, "rerun_analysis": rerun, "full_run": full_run, "resumed_run": resumed_run, "streamed_market": streamed_market,
}


def sql() -> dict[str, str]:
    c = O.cents
    lot = O.PRODUCTS.replace("CAST(round(p_retailprice*100) AS BIGINT) AS lot_c", "CAST(round(p_retailprice*100) AS BIGINT)*(p_partkey%60+1) AS lot_c")
    priced = O.LISTINGS.replace("l AS (", "l0 AS (", 1) + """,
l AS (SELECT * REPLACE (CASE WHEN product_id%50=0 THEN 0 ELSE price_c END AS price_c, CASE WHEN product_id%6=0 THEN 0 ELSE sold*(product_id%41)//20 END AS sold, seller_id%(product_id%37+1) AS seller_id), seller_id%10*(product_id%2)+1 AS sure FROM l0)"""
    sure = O.MARKET.replace("1000 AS conf", f"{O.half_even('CAST(sum(sure) AS DOUBLE)*100/count(*)')} AS conf")
    to_market = ",\n".join(["WITH " + priced, O.PRICES, sure])
    to_scores = ",\n".join([to_market, lot, O.FINANCE, O.SCORES])
    skew = O.TO_MARKET.replace("1000 AS conf", "1000 AS conf, CAST(sum(price_c) AS DOUBLE)/count(*) AS mean_c")
    hard = ",\n".join([O.TO_MARKET.replace("\nm AS (", "\nm0 AS ("), """m AS (SELECT * REPLACE (CASE WHEN product_id%13=0 AND product_id%2=0 THEN 99 WHEN product_id%13=0 THEN 1000 WHEN product_id%19=0 THEN NULL ELSE avg_c END AS avg_c) FROM m0)""", O.PRODUCTS.replace("p AS (", "p0 AS (", 1), """p AS (SELECT * REPLACE (CASE WHEN product_id%11=0 THEN NULL WHEN product_id%13=0 THEN 99999900 WHEN product_id%17=0 THEN 0 ELSE lot_c END AS lot_c, CASE WHEN product_id%13=0 THEN 1 ELSE units END AS units) FROM p0)""", O.FINANCE])
    unfit = ", ".join(f"CASE WHEN abs({x})>{most} THEN '{name}' END" for x, name, most in (("gross_bp", "gross_margin_pct", 9999999999), ("net_bp", "net_margin_pct", 9999999999)))
    faults = f"""{hard}, judged AS (SELECT f.*, p.lot_c, concat_ws(',', {unfit}) AS unfit FROM f JOIN p USING (product_id)),
faults AS (SELECT *, CASE WHEN lot_c IS NULL THEN 'no_cost' WHEN lot_c<=0 THEN 'non_positive_cost' WHEN price_c IS NULL THEN 'no_price' WHEN unfit<>'' THEN 'overflow' END AS reason FROM judged)"""
    plain = ",\n".join([O.TO_MARKET, O.PRODUCTS, f"""f0 AS (SELECT product_id, {O.half_up("lot_c", "units")} AS cost_c, avg_c AS price_c, avg_c>0 AS sold FROM p JOIN m USING (product_id)),
f1 AS (SELECT *, {O.half_up("price_c*15", "100")} AS fee_c, {O.half_up("cost_c*100", "85")} AS even_c FROM f0), f2 AS (SELECT *, price_c-cost_c-fee_c AS gross_c FROM f1)"""])
    again = O.TO_MARKET.replace("\nm AS (", "\nm0 AS (") + ", m AS (SELECT * REPLACE (CASE WHEN n>30 THEN avg_c+100000 ELSE avg_c END AS avg_c) FROM m0)"
    again = ",\n".join([again, O.PRODUCTS, O.FINANCE, O.SCORES])
    whole = f"""{sheets.SHEETS}, p AS (SELECT cid||'-'||(head+n) AS product_id, CAST(cid AS VARCHAR) AS catalog_id, {sheets.NAME} AS raw_name, pk, pk*7%90000+1 AS lot_c, 1 AS units FROM good JOIN judged USING (cid) WHERE confidence<>'FAILED'),
m AS (SELECT product_id, 1 AS sellers, 1 AS n, 750 AS conf, p_size*1000 AS avg_sold, p_size*1000 AS total_sold, CAST(NULL AS BIGINT) AS fee_bp, CASE WHEN p_size%2=0 THEN 10000 ELSE 0 END AS free_bp, CAST(round(p_retailprice*100) AS BIGINT)*2 AS avg_c FROM p JOIN part ON pk=p_partkey), {O.FINANCE}, {O.SCORES}"""
    progress = "CASE o_orderkey%7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate((0, 10, 30, 70, 88, 100, 0))) + " END"
    final = c("final_c", "final_score")
    return {
        "scores_spread": f"{to_scores} SELECT product_id, catalog_id, CAST(ds AS DOUBLE) AS demand_score, CAST(ms AS DOUBLE) AS margin_score, CAST(cs AS DOUBLE) AS competition_score, CAST(conf AS DOUBLE)/10 AS confidence_score, {final}, recommendation, rank_position, explanation, CAST(conf AS DOUBLE)/1000 AS avg_match_confidence FROM s",
        "finance_spread": f"{to_scores} SELECT product_id, {c('cost_c', 'cost')}, {c('price_c', 'avg_market_price')}, {c('ml_fee_c', 'ml_fee')}, {c('gross_c', 'gross_margin')}, {c('gross_bp', 'gross_margin_pct')}, {c('even_c', 'break_even_price')}, {c('safety_bp', 'price_safety_margin_pct')}, {c('net_c', 'net_margin')}, {c('net_bp', 'net_margin_pct')}, is_viable, {c('least_c', 'min_price_for_target_margin')}, {O.SUMMARY} AS summary FROM f",
        "finance_isolated": f"{faults} SELECT product_id, {c('cost_c', 'cost')}, {c('price_c', 'avg_market_price')}, {c('gross_bp', 'gross_margin_pct')}, {c('net_c', 'net_margin')}, {c('net_bp', 'net_margin_pct')}, is_viable, {c('least_c', 'min_price_for_target_margin')} FROM faults WHERE reason IS NULL",
        "finance_quarantine": f"{faults} SELECT product_id, catalog_id, {c('lot_c', 'cost')}, {c('price_c', 'avg_price')}, reason, CASE reason WHEN 'overflow' THEN unfit WHEN 'no_price' THEN 'avg_price' ELSE 'cost' END AS fields FROM faults WHERE reason IS NOT NULL",
        "finance_default": f"{plain} SELECT product_id, {c('fee_c', 'ml_fee')}, {c('gross_c', 'gross_margin')}, CAST({O.half_up('gross_c*10000', 'price_c')} AS DOUBLE)/100 AS gross_margin_pct, {c('even_c', 'break_even_price')}, CAST(least({O.half_up('(price_c-even_c)*10000', 'even_c')}, 99999) AS DOUBLE)/100 AS price_safety_margin_pct, CAST(NULL AS DOUBLE) AS net_margin, CAST(NULL AS DOUBLE) AS net_margin_pct, gross_c>0 AS is_viable, CAST(NULL AS DOUBLE) AS min_price_for_target_margin FROM f2 WHERE sold",
        "price_skew": f"{skew} SELECT product_id, mean_c>0 AND abs(avg_c-mean_c)/mean_c>0.10 AS price_skewed FROM m",
        "opportunities_good": f"{to_scores} SELECT product_id, catalog_id, {final}, rank_position, recommendation, {c('avg_c', 'avg_price')}, is_viable FROM s WHERE recommendation='BOA' AND final_c>=6000",
        "filtered_excellent": f"{to_scores} SELECT product_id, {final}, {c('gross_bp', 'gross_margin_pct')} FROM s WHERE is_viable AND final_c>=7500 AND gross_bp>=0",
        "filtered_any": f"{to_scores} SELECT product_id, {final}, {c('gross_bp', 'gross_margin_pct')} FROM s WHERE final_c>=3000 AND gross_bp>=-500 AND n>=25",
        "listings_of": f"{O.TO_LISTINGS} SELECT product_id, position AS rank_position, item_id FROM l WHERE product_id=7 AND position<=5",
        "ranked_scores": f"{to_scores} SELECT product_id, rank_position FROM s WHERE catalog_id='Brand#7'",
        "catalogs_of": "SELECT o_orderkey AS catalog_id, o_custkey AS user_id FROM orders WHERE o_custkey=5 ORDER BY o_orderdate DESC, o_orderkey LIMIT 4",
        "page": "SELECT p_partkey AS product_id, p_name||' CX'||p_size AS raw_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100",
        "sample_products": f"{to_scores} SELECT product_id, raw_name, n AS listings, {c('gross_bp', 'gross_margin_pct')}, rank_position, recommendation FROM s JOIN p USING (product_id) ORDER BY product_id LIMIT 10",
        "stage_progress": f"SELECT o_orderkey, {progress} AS done, CASE WHEN o_orderkey%7=2 AND o_custkey>50 THEN CAST(ceil(o_custkey/30.0) AS BIGINT) END AS minutes_left FROM orders",
        "latest_status": "SELECT user_id AS catalog_id, arg_max(event_type, ts) AS status, count(*) AS changes FROM events GROUP BY user_id",
        "cleared_scores": f"{to_scores} SELECT product_id, rank_position FROM s WHERE catalog_id<>'Brand#3'",
        "backfilled_fees": f"{to_scores} SELECT product_id, CAST(CASE WHEN product_id%3=0 THEN ml_fee_c ELSE ml_fee_c+100 END AS DOUBLE)/100 AS ml_fee FROM f",
        "rerun_analysis": f"{again} SELECT product_id, {c('price_c', 'avg_market_price')}, {c('gross_bp', 'gross_margin_pct')}, {final}, rank_position FROM s",
        "full_run": f"{whole} SELECT product_id, catalog_id, {c('cost_c', 'cost')}, {c('price_c', 'avg_market_price')}, {c('net_bp', 'net_margin_pct')}, CAST(conf AS DOUBLE)/10 AS confidence_score, {final}, rank_position, is_viable FROM s",
        "resumed_run": f"{O.TO_SCORES} SELECT product_id, catalog_id, {c('price_c', 'avg_market_price')}, {final}, rank_position, recommendation FROM s",
        "streamed_market": f"{O.TO_MARKET} SELECT product_id, {c('avg_c', 'avg_price')}, n AS total_listings_found, total_sold AS total_sold_quantity FROM m",
    }
