"""Queries, filters and reports (Q1 to Q16)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V

#: Progress of each status, in percent.
PROGRESS = {"PENDING": 0, "PARSING": 10, "RESEARCHING": 30, "ANALYZING": 70, "SCORING": 88, "READY": 100}


@dataclass(frozen=True)
class OpportunityFilter:
    """Q4, Q5: which opportunities to show."""

    min_final_score: float = 0.0
    min_margin_pct: float = 0.0
    min_demand_listings: int = 0
    recommendations: tuple[str, ...] | None = None
    only_viable: bool = True

    @classmethod
    def only_excellent(cls) -> OpportunityFilter:
        return cls(min_final_score=75.0, recommendations=("EXCELENTE",))

    @classmethod
    def good_and_above(cls, min_margin: float = 20.0) -> OpportunityFilter:
        return cls(min_final_score=55.0, min_margin_pct=min_margin, recommendations=("EXCELENTE", "BOA"))

    def predicate(self) -> Column:
        found = (F.col("final_score") >= self.min_final_score) & (F.col("gross_margin_pct") >= self.min_margin_pct) & (F.col("listings_above_threshold") >= self.min_demand_listings)
        if self.only_viable:
            found &= F.col("is_viable")
        return found if self.recommendations is None else found & F.col("recommendation").isin(*self.recommendations)


def opportunities(products: DataFrame, scores: DataFrame, market: DataFrame, finance: DataFrame, listings: DataFrame | None = None, recommendation: str | None = None, min_score: float | None = None) -> DataFrame:
    """Q1, Q2: scored products with market, finance and nested listings; min_score 0 is no filter."""
    own = lambda df: df.select("product_id", *[c for c in df.columns if c not in ("product_id", "catalog_id", "cost", *scores.columns)])
    chosen = scores
    if recommendation:
        chosen = chosen.filter(F.col("recommendation") == recommendation)
    if min_score:
        chosen = chosen.filter(F.col("final_score") >= min_score)
    money = own(market)
    out = products.drop("cost").join(chosen.drop("catalog_id"), "product_id").join(money, "product_id", "left")
    out = out.join(finance.select("product_id", *[c for c in finance.columns if c not in out.columns]), "product_id", "left")
    if listings is None:
        return out
    cols = [c for c in listings.columns if c != "product_id"]
    nested = listings.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("rank_position", *[c for c in cols if c != "rank_position"]))).alias("listings"))  # five a product
    return out.join(nested, "product_id", "left")


def by_rank(df: DataFrame) -> DataFrame:
    """Q1, Q7: in order of catalogs and ranks."""
    return df.orderBy("catalog_id", "rank_position")


def listings_of(listings: DataFrame, product_id) -> DataFrame:
    """Q3: a product's listings by rank."""
    return listings.filter(F.col("product_id") == product_id).orderBy("rank_position")


def opportunity_filter(scores: DataFrame, market: DataFrame, finance: DataFrame, f: OpportunityFilter = OpportunityFilter()) -> DataFrame:
    """Q4: products that have all three analyses and pass the filter."""
    df = scores.select("product_id", "catalog_id", "final_score", "recommendation", "rank_position")
    df = df.join(finance.select("product_id", "is_viable", "gross_margin_pct"), "product_id").join(market.select("product_id", "listings_above_threshold"), "product_id")
    return df.filter(f.predicate())


def recommendation_counts(scores: DataFrame) -> DataFrame:
    """Q6: products per class and catalog, classes without any too."""
    counts = scores.groupBy("catalog_id").pivot("recommendation", V.CLASSES).count()
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("recommendation"), F.coalesce(F.col(c), F.lit(0)).alias("products")) for c in V.CLASSES]))
    return counts.select("catalog_id", cells)


def ranked_scores(scores: DataFrame, catalog_id: str) -> DataFrame:
    """Q7."""
    return scores.filter(F.col("catalog_id") == catalog_id).orderBy("rank_position")


def catalogs_of(catalogs: DataFrame, user_id, limit: int = 50) -> DataFrame:
    """Q8: a user's catalogs, newest first."""
    return catalogs.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "catalog_id").limit(limit)


def page(df: DataFrame, *order: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """Q9."""
    return df.orderBy(*order).offset(offset).limit(limit)


def progress(done: str, total: str) -> Column:
    """Q10: percent with a decimal; null when the total is unknown."""
    return F.bround(F.try_divide(F.col(done).cast("double"), F.col(total).cast("double")) * 100, 1)


def pipeline_coverage(products: DataFrame, market: DataFrame, finance: DataFrame, scores: DataFrame) -> DataFrame:
    """Q11, Q12: per catalog how many products reached each stage, the share in percent, and where it stops."""
    have = {"market": market, "finance": finance, "scores": scores}
    df = products.select("catalog_id", "product_id")
    for name, stage in have.items():
        df = df.join(stage.select("product_id", F.lit(1).alias(name)), "product_id", "left")
    out = df.groupBy("catalog_id").agg(F.count("*").alias("products"), *[F.count(n).alias(n) for n in have])
    return out.withColumns({f"{n}_pct": progress(n, "products") for n in have} | {"bottleneck": bottleneck()})


def bottleneck() -> Column:
    """Q12."""
    return F.when(F.col("products") == 0, "PARSING").when(F.col("market") == 0, "MARKET").when(F.col("finance") == 0, "FINANCE").when(F.col("scores") == 0, "SCORING").when(F.col("scores") < F.col("products"), "PARTIAL").otherwise("OK")


def sample_products(opportunity: DataFrame, n: int = 10) -> DataFrame:
    """Q13: the first products with what each stage made of them, nested."""
    first = opportunity.orderBy("product_id").limit(n)
    stages = {"market": ["avg_price", "total_listings_found", "avg_sold_quantity"], "finance": ["gross_margin_pct", "is_viable"], "score": ["final_score", "rank_position", "recommendation"]}
    return first.select("product_id", "raw_name", *[F.struct(*cols).alias(n) for n, cols in stages.items()])


def dashboard_view(opportunity: DataFrame) -> DataFrame:
    """Q14: the margin's band, whether shipping is mostly free, the price to show."""
    band = F.when(F.col("gross_margin_pct") >= 20, "high").when(F.col("gross_margin_pct") >= 10, "medium").otherwise("low")
    return opportunity.withColumns({"margin_band": band, "mostly_free_shipping": F.coalesce(F.col("free_shipping_pct") > 50, F.lit(False)), "effective_price": F.coalesce("avg_market_price", "avg_price")})


def products_of(products: DataFrame, catalog_id: str) -> DataFrame:
    """Q15."""
    return products.filter(F.col("catalog_id") == catalog_id)


def stage_progress(status: str = "status", products: str = "total_products") -> tuple[Column, Column]:
    """Q16: percent done, and minutes left for catalogs in research with more than 50 products."""
    done = F.coalesce(F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])[F.col(status)], F.lit(0))
    return done, F.when((F.col(status) == "RESEARCHING") & (F.col(products) > 50), F.ceil(F.col(products) / 30))
