"""Market aggregation per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.price import MONEY
from ..sources.shared import materialize
from .ordering import carried, numbered
from .selection import at_places

#: Listings of a product that one task sorts at most.
HEAVY = 5_000_000


def pending(products: DataFrame, market: DataFrame) -> DataFrame:
    """K1: products without a market row."""
    return products.join(market.select("product_id"), "product_id", "left_anti")


def distinct_queries(products: DataFrame) -> DataFrame:
    """K2: queries that aren't blank, once each."""
    return products.filter(F.trim("query") != "").select("query").distinct()


def batch_id(df: DataFrame, key: str, size: int = 40, within: str = "catalog_id") -> DataFrame:
    """K3: batches of so many rows within each catalog, in order of key."""
    out = numbered(df, [within], [F.col(key)], "batch_id")
    return out.withColumn("batch_id", F.floor((F.col("batch_id") - 1) / size).cast("int"))


def assemble_pages(pages: DataFrame, page_size: int = 50, most: int = 2) -> DataFrame:
    """K4: (query, page, results) pages up to the first short one, `most` at most."""
    w = Window.partitionBy("query")
    short = F.min(F.when(F.size("results") < page_size, F.col("page"))).over(w)
    return pages.withColumn("__short", short).filter((F.col("page") < most) & (F.col("__short").isNull() | (F.col("page") <= F.col("__short")))).drop("__short")


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def enrich(listings: DataFrame, details: DataFrame, fees: DataFrame | None = None, first: int = 20) -> DataFrame:
    """K5, K6: the first so many listings of each product take what item details and fees tell.

    The first ones, by position and item, are found by a ranking that each task cuts at `first` before rows are
    shuffled, and marked by a join, so that a product's listings don't meet in one task.
    details: item_id, d_sold, d_condition, d_listing_type, d_seller_id, d_free_shipping, d_logistic_type,
    d_category_id; of an item's repeated rows the greatest counts. fees: category_id, price_from, price_to
    (exclusive), fee_pct. Both are joined by key; a listing stays one row whatever repeats.
    """
    ranked = listings.select("product_id", "position", "item_id").withColumn("__n", F.row_number().over(Window.partitionBy("product_id").orderBy("position", "item_id")))
    head = ranked.filter(F.col("__n") <= first).select("product_id", "position", "item_id", F.lit(True).alias("__head")).distinct()
    told = [c for c in details.columns if c != "item_id"]
    once = details.groupBy("item_id").agg(F.max(F.struct(*told)).alias("d")).select("item_id", "d.*", F.lit(True).alias("__known"))
    df = listings.join(head, ["product_id", "position", "item_id"], "left").withColumn("__head", F.coalesce("__head", F.lit(False))).join(once, "item_id", "left")
    on = F.col("__head") & F.coalesce("__known", F.lit(False))
    take = lambda c, d, when: F.when(on & when, F.col(d)).otherwise(F.col(c))
    df = df.withColumns({
        "sold_quantity": F.when(on, F.coalesce("d_sold", F.lit(0))).otherwise(F.col("sold_quantity")),
        "condition": take("condition", "d_condition", blank("condition")),
        "listing_type": take("listing_type", "d_listing_type", blank("listing_type")),
        "seller_id": take("seller_id", "d_seller_id", F.coalesce("seller_id", F.lit(0)) == 0),
        "free_shipping": take("free_shipping", "d_free_shipping", F.lit(True)),
        "logistic_type": take("logistic_type", "d_logistic_type", F.lit(True)),
        "category_id": take("category_id", "d_category_id", blank("category_id")),
    }).drop("__known", *[c for c in details.columns if c.startswith("d_")])
    return (lookup_fee(df, fees) if fees is not None else df).drop("__head")


def lookup_fee(listings: DataFrame, fees: DataFrame) -> DataFrame:
    """K6: the fee of a listing's category and price band, for rows marked __head.

    An as-of join: listings and bands of a category lie in one order of prices, dealt out by ranges, and the last
    band is carried along it. Neither a category's listings nor its bands meet in one task, and no listing meets a
    band that isn't its own. Bands of a category don't overlap; where they begin at one price the last to end counts.
    """
    wanted = F.col("__head") & ~blank("category_id") & (F.col("price") > 0)
    keep = listings.columns
    given = listings.select(F.when(wanted, F.col("category_id")).alias("__c"), F.col("price").alias("__p"), F.lit(1).alias("__kind"), F.struct(*keep).alias("__row"), wanted.alias("__wanted"), F.lit(None).cast("struct<until:decimal(12,2),fee:decimal(5,2)>").alias("__band"))
    bands = fees.select(F.col("category_id").alias("__c"), F.col("price_from").cast(MONEY).alias("__p"), F.lit(0).alias("__kind"), F.lit(None).cast(given.schema["__row"].dataType).alias("__row"), F.lit(False).alias("__wanted"), F.struct(F.col("price_to").cast(MONEY).alias("until"), F.col("fee_pct").cast("decimal(5,2)").alias("fee")).alias("__band"))
    # rows that look nothing up are spread by a hash, not gathered under the null category
    both = given.withColumn("__c", F.when(F.col("__wanted"), F.concat(F.lit("c"), F.col("__c"))).otherwise(F.concat(F.lit("-"), (F.monotonically_increasing_id() % 1024).cast("string")))).unionByName(bands.withColumn("__c", F.concat(F.lit("c"), F.col("__c"))))
    found = carried(both, ["__c"], ["__p", "__kind", "__band"], {"__last": F.col("__band")}).filter("__kind = 1")
    fee = F.when(F.col("__p") < F.col("__last.until"), F.col("__last.fee"))
    out = found.select("__row", "__wanted", fee.alias("__fee"))
    return out.select(*[F.when(F.col("__wanted"), F.col("__fee")).otherwise(F.col("__row.ml_fee_pct")).alias(c) if c == "ml_fee_pct" else F.col(f"__row.{c}").alias(c) for c in keep])


def enrich_pages(listings: DataFrame, details: DataFrame, first: int = 5, misses: int = 2) -> DataFrame:
    """The first rows of a page take all details, price too, until two in a row have none; then by units sold."""
    by = Window.partitionBy("product_id").orderBy("position")
    df = listings.join(details.withColumn("__known", F.lit(True)), "item_id", "left").withColumn("__n", F.row_number().over(by))
    miss = F.col("__known").isNull() & (F.col("__n") <= first)
    df = df.withColumn("__miss", miss.cast("int")).withColumn("__two", (F.sum("__miss").over(by.rowsBetween(1 - misses, 0)) == misses) & (F.col("__n") >= misses))
    df = df.withColumn("__over", F.coalesce(F.max("__two").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    on = F.col("__known").isNotNull() & (F.col("__n") <= first) & ~F.col("__over")
    named = {"sold_quantity": "d_sold", "condition": "d_condition", "listing_type": "d_listing_type", "seller_id": "d_seller_id", "free_shipping": "d_free_shipping", "logistic_type": "d_logistic_type", "category_id": "d_category_id", "price": "d_price"}
    df = df.withColumns({c: F.when(on, F.col(d)).otherwise(F.col(c)) for c, d in named.items()})
    order = Window.partitionBy("product_id").orderBy(F.desc("sold_quantity"), "position")
    df = df.withColumn("__at", F.row_number().over(order)).withColumn("position", F.col("__at"))
    return df.drop("__known", "__n", "__miss", "__two", "__over", "__at", *[c for c in details.columns if c.startswith("d_")])


def sales_filter(listings: DataFrame, min_sales: int) -> DataFrame:
    """K7: listings with enough sales; all of a product that has none. No minimum is no filter."""
    if min_sales <= 0:
        return listings
    enough = F.col("sold_quantity") >= min_sales
    some = listings.groupBy("product_id").agg(F.max(enough).alias("__any"))
    return listings.join(some, "product_id").filter(enough | ~F.col("__any")).drop("__any")


def cut() -> tuple[Column, Column]:
    """K8: of n prices, how many of the lowest are left out, and how many stay after the highest are left out too."""
    tenth = F.expr("n div 10 + CASE WHEN n % 10 > 5 OR n % 10 = 5 AND (n div 10) % 2 = 1 THEN 1 ELSE 0 END")  # to the nearest, halves to even
    low, high = F.greatest(F.lit(1).cast("long"), tenth), F.greatest(F.lit(1).cast("long"), F.expr("(n + 2) div 5"))
    n = F.col("n")
    whole = (n <= 3) | (low + high >= n)
    return F.when(whole, 0).otherwise(low).cast("long"), F.when(whole, n).otherwise(n - low - high)


def places() -> dict[str, Column]:
    """K8: the places, from 0, of the prices that make a product's row: the middle ones (one place twice if n is odd) and the quartiles."""
    few, (low, t) = F.col("n") <= 3, cut()
    half = lambda c: F.shiftright(c, 1)
    found = {"a": half(t - 1), "b": half(t), "p25": F.when(few, 0).otherwise(F.shiftright(t, 2)), "p75": F.when(few, t - 1).otherwise(F.least(t - 1, F.shiftright(t * 3, 2)))}
    return {k: low + v for k, v in found.items()}


def prices() -> dict[str, Column]:
    """K8 from the cents at its places."""
    reais = lambda c: (c.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)
    median = F.bround((F.col("a") + F.col("b")).cast("decimal(20,0)") * F.lit("0.005").cast("decimal(4,3)"), 2)
    return {"avg_price": median.cast(MONEY), "min_price": reais(F.col("p25")), "max_price": reais(F.col("p75"))}


def in_cents(listings: DataFrame) -> Column:
    return (F.col("price").cast(MONEY) * 100).cast("long")


def heavy_products(rows: DataFrame, most: int) -> DataFrame | None:
    """product_id of products with more rows than one task should sort: over `most`, and over a 10,000th of all, so that they are 10,000 at most; None if there are none. Reads keys alone."""
    counts = rows.groupBy("product_id").agg(F.count("*").alias("rows"))
    largest, total = counts.agg(F.max("rows"), F.sum("rows")).first()
    limit = max(most, (total or 0) // 10_000)
    return materialize(counts.filter(F.col("rows") > limit).select("product_id"), "heavy") if (largest or 0) > limit else None


def sorted_places(rows: DataFrame, aggregates: list[Column]) -> DataFrame:
    """Aggregates of each product, n and the cents at its places: one exchange by product serves the sort, the places and the aggregates."""
    by = Window.partitionBy("product_id")
    ranked = rows.withColumn("k", F.row_number().over(by.orderBy(F.col("cents").asc_nulls_last())) - 1).withColumn("n", F.count("cents").over(by))
    known = ranked.withColumns({f"at_{name}": place for name, place in places().items()})
    at = [F.max(F.when(F.col("k") == F.col(f"at_{name}"), F.col("cents"))).alias(name) for name in places()]
    return known.groupBy("product_id").agg(F.max("n").alias("n"), *aggregates, *at)


def selected_places(rows: DataFrame, found: DataFrame, times: str | None = None) -> DataFrame:
    """The cents at the places of heavy products, by selection; no task holds a product. found: product_id, n; times: how often each row counts."""
    wanted = found.filter("n > 0").select("product_id", F.inline(F.array(*[F.struct(F.lit(name).alias("name"), place.alias("place")) for name, place in places().items()])))
    at = at_places(rows, wanted, times=times).groupBy("product_id")
    return at.agg(*[F.max(F.when(F.col("name") == name, F.col("cents"))).alias(name) for name in places()])


def with_places(rows: DataFrame, aggregates: list[Column], most: int) -> DataFrame:
    """Aggregates, n and places of every product: heavy ones by selection, all others by one exchange."""
    heavy = heavy_products(rows, most)
    if heavy is None:
        return sorted_places(rows, aggregates)
    known = F.broadcast(heavy)  # 10,000 rows at most
    light = sorted_places(rows.join(known, "product_id", "left_anti"), aggregates)
    large = rows.join(known, "product_id", "left_semi")
    found = materialize(large.groupBy("product_id").agg(F.count("cents").alias("n"), *aggregates), "heavy-products")
    return light.unionByName(found.join(selected_places(large, found), "product_id", "left"))


def counted_places(counts: DataFrame, most: int = HEAVY) -> DataFrame:
    """product_id, n and the cents at its places, from (product_id, cents, times); a product's distinct prices are sorted in one task up to `most`."""
    by = Window.partitionBy("product_id")

    def sorted_(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("upto", F.sum("times").over(by.orderBy("cents").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("times").over(by))
        known = ranked.withColumns({f"at_{name}": place for name, place in places().items()})
        here = lambda name: (F.col(f"at_{name}") < F.col("upto")) & (F.col(f"at_{name}") >= F.col("upto") - F.col("times"))
        return known.groupBy("product_id").agg(F.max("n").alias("n"), *[F.max(F.when(here(name), F.col("cents"))).alias(name) for name in places()])

    heavy = heavy_products(counts, most)
    if heavy is None:
        return sorted_(counts)
    known = F.broadcast(heavy)  # 10,000 rows at most
    large = counts.join(known, "product_id", "left_semi")
    found = materialize(large.groupBy("product_id").agg(F.sum("times").alias("n")), "heavy-products")
    return sorted_(counts.join(known, "product_id", "left_anti")).unionByName(found.join(selected_places(large, found, "times"), "product_id", "left"))


def competitive_price(listings: DataFrame, most: int = HEAVY) -> DataFrame:
    """K8: avg_price (trimmed median), min_price and max_price (its quartiles) per product with a price.

    A product of up to `most` listings is sorted in one task; larger ones are never (see heavy_products).
    """
    rows = listings.filter("price IS NOT NULL").select("product_id", in_cents(listings).alias("cents"))
    return with_places(rows, [], most).select("product_id", *[v.alias(k) for k, v in prices().items()])


def facts_of(listings: DataFrame) -> DataFrame:
    """What K9 needs of each listing, in whole numbers: cents, units sold, hundredths of fees, ten-thousandths of scores; sellers of 0 are none."""
    types = {f.name: f.dataType for f in listings.schema}
    facts = {"cents": in_cents(listings), "seller_id": F.nullif("seller_id", F.lit(0).cast(types["seller_id"])), "sold": F.col("sold_quantity").cast("long"), "fee": (F.col("ml_fee_pct") * 100).cast("long"), "free": F.coalesce(F.col("free_shipping").cast("long"), F.lit(0).cast("long"))}
    facts["score"] = F.round(F.col("match_score") * 10000).cast("long") if "match_score" in types else F.lit(None).cast("long")
    return listings.select("product_id", *[v.alias(k) for k, v in facts.items()])


def sums_of_facts() -> dict[str, Column]:
    """Sums of K9's facts by name; those of parts of a product's listings add up to the product's."""
    return {"listings": F.count("*"), "sold": F.coalesce(F.sum("sold"), F.lit(0)), "value": F.sum("cents"), "free": F.sum("free"), "fee": F.sum("fee"), "n_fee": F.count("fee"), "score": F.sum("score"), "n_score": F.count("score")}


def market_rows(found: DataFrame) -> DataFrame:
    """K9 from a product's sums, number of sellers and places."""
    n = F.col("listings")
    of = lambda a, b, unit: F.try_divide(F.col(a).cast("decimal(20,0)") * F.lit(unit).cast("decimal(5,4)"), F.col(b).cast("decimal(14,0)"))
    return found.filter("n > 0").select(
        "product_id", "total_sellers", n.alias("total_listings_found"), n.alias("listings_above_threshold"), F.floor(F.col("sold") / n).cast("long").alias("avg_sold_quantity"), F.col("sold").alias("total_sold_quantity"),
        F.bround(of("score", "n_score", "0.0001"), 3).cast("decimal(4,3)").alias("avg_match_confidence"), F.bround(of("fee", "n_fee", "0.01"), 2).cast("decimal(5,2)").alias("avg_ml_fee_pct"),
        F.bround((F.col("free") * 100).cast("decimal(20,0)") / n.cast("decimal(14,0)"), 2).cast("decimal(5,2)").alias("free_shipping_pct"), of("value", "n", "0.01").alias("mean_price"), *[v.alias(k) for k, v in prices().items()],
    ).withColumn("price_skewed", price_skew_flag())


def market_analysis(listings: DataFrame, most: int = HEAVY) -> DataFrame:
    """K9: one row per product with a price. match_score is optional.

    Listings are read once for their keys, to find products of over `most` listings, and once for their facts: these
    cross the network once, by product; heavy products by selection instead.
    """
    sums = [*[a.alias(k) for k, a in sums_of_facts().items()], F.countDistinct("seller_id").alias("total_sellers")]
    return market_rows(with_places(facts_of(listings), sums, most))


def price_skew_flag() -> Column:
    """The competitive price is more than a tenth off the mean."""
    mean = F.col("mean_price").cast("double")
    return (mean > 0) & (F.abs(F.col("avg_price").cast("double") - mean) / mean > 0.10)


def top_listings(listings: DataFrame, n: int = 5) -> DataFrame:
    """The first listings of each product in feed order, with rank_position; zeros and blanks as null."""
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy("position"))
    df = listings.withColumn("rank_position", rank).filter(F.col("rank_position") <= n)
    df = df.withColumn("sold_quantity", F.nullif("sold_quantity", F.lit(0).cast(df.schema["sold_quantity"].dataType)))
    df = df.withColumns({c: F.nullif(c, F.lit("")) for c in ("permalink", "thumbnail", "logistic_type", "category_id") if c in df.columns})
    return df.withColumn("match_confidence", F.bround("match_score", 3)) if "match_score" in df.columns else df


def choose_feed(batch: DataFrame | None, api: DataFrame | None, page: DataFrame | None) -> DataFrame:
    """The first feed that is configured; one only."""
    for feed in (batch, api, page):
        if feed is not None:
            return feed
    raise ValueError("no feed is configured")
