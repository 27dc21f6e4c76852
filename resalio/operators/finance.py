"""Margins, break-even, viability (F1 to F12): decimals, each step rounded half up and used rounded."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.price import MONEY, unit_cost

PCT, RATE = "decimal(10,2)", "decimal(38,12)"
MOST_SAFETY = "999.99"


@dataclass(frozen=True)
class FeeConfig:
    """percentages and amounts in reais."""

    ml_fee_pct: Decimal = Decimal("15")
    ads_pct: Decimal = Decimal(0)
    return_rate_pct: Decimal = Decimal(0)
    packaging_cost_brl: Decimal = Decimal(0)
    fulfillment_cost_brl: Decimal = Decimal(0)
    tax_pct: Decimal = Decimal(0)
    min_viable_margin_pct: Decimal = Decimal("20")

    @classmethod
    def from_settings(cls) -> FeeConfig:
        return cls(ml_fee_pct=Decimal("11"), fulfillment_cost_brl=Decimal("20"), tax_pct=Decimal("7"))

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(v).cast(MONEY if k.endswith("brl") else PCT) for k, v in vars(self).items()}


def fee_columns(market: DataFrame, config: FeeConfig = FeeConfig.from_settings()) -> DataFrame:
    """each product's fees: its market's fee if known; no shipping if under half of its market ships free."""
    own = config.columns()
    own["ml_fee_pct"] = F.coalesce(F.col("avg_ml_fee_pct").cast(PCT), own["ml_fee_pct"])
    own["fulfillment_cost_brl"] = F.when(F.col("free_shipping_pct") <= 50, F.lit(0).cast(MONEY)).otherwise(own["fulfillment_cost_brl"])
    return market.withColumns(own)


def money(c: Column) -> Column:
    """An amount to two places; null beyond the type."""
    return F.round(c.cast(RATE), 2).try_cast(MONEY)


def share(c: Column) -> Column:
    """A percentage to two places; null beyond the type."""
    return F.round(c.cast(RATE), 2).try_cast(PCT)


def of(amount: str, pct: str) -> Column:
    """A percentage of an amount."""
    return money(F.col(amount) * F.col(pct) * F.lit("0.01").cast("decimal(3,2)"))


def ratio(a: Column, b: Column) -> Column:
    """a / b in percent."""
    return share(F.try_divide(a.cast("decimal(24,4)"), b.cast("decimal(14,4)")) * 100)


def computed(df: DataFrame) -> tuple[DataFrame, Column]:
    """F3 to F10 for rows of cost, avg_market_price and fee columns, and the names of the fields that are due but don't fit their types (an array, empty in a good row).

    Every step is worked out in a wide type and comes out null where its own type can't hold it, so that no row
    stops a run.
    """
    hundredth = F.lit("0.01").cast("decimal(3,2)")
    df = df.withColumns({"cost": F.col("cost").try_cast(MONEY), "avg_market_price": F.col("avg_market_price").try_cast(MONEY)})
    sold, zero = F.col("avg_market_price") > 0, F.lit(0).cast(MONEY)
    df = df.withColumn("ml_fee", F.when(sold, of("avg_market_price", "ml_fee_pct")).otherwise(zero))
    df = df.withColumn("gross_revenue", F.when(sold, F.col("avg_market_price")).otherwise(zero))
    df = df.withColumn("gross_margin", F.when(sold, money(F.col("avg_market_price") - F.col("cost") - F.col("ml_fee"))).otherwise(money(-F.col("cost"))))
    df = df.withColumn("gross_margin_pct", F.when(sold, ratio(F.col("gross_margin"), F.col("avg_market_price"))).otherwise(F.lit(0).cast(PCT)))
    left = F.lit(1) - F.col("ml_fee_pct") * hundredth
    even = F.when(left <= 0, F.col("avg_market_price")).otherwise(money(F.try_divide(F.col("cost").cast("decimal(24,4)"), left.cast("decimal(14,4)"))))
    df = df.withColumn("break_even_price", F.when(sold, even).otherwise(F.col("cost")))
    # least() passes nulls over: a safety margin beyond its type is over the most, too
    safety = F.least(ratio(F.col("avg_market_price") - F.col("break_even_price"), F.col("break_even_price")), F.lit(MOST_SAFETY).cast(PCT))
    df = df.withColumn("price_safety_margin_pct", F.when(sold & (F.col("break_even_price") > 0), safety).otherwise(F.lit(0).cast(PCT)))
    fixed = F.col("fulfillment_cost_brl") + F.col("packaging_cost_brl")
    extra = (F.col("ads_pct") > 0) | (F.col("return_rate_pct") > 0) | (fixed > 0) | (F.col("tax_pct") > 0)
    net = money(F.col("gross_margin") - of("avg_market_price", "ads_pct") - of("cost", "return_rate_pct") - fixed - of("avg_market_price", "tax_pct"))
    df = df.withColumn("net_margin", F.when(sold & extra, net))
    df = df.withColumn("net_margin_pct", F.when(sold & extra, ratio(F.col("net_margin"), F.col("avg_market_price"))))
    df = df.withColumn("is_viable", F.when(~sold, F.lit(False)).when(extra, F.col("net_margin_pct") >= F.col("min_viable_margin_pct")).otherwise(F.col("gross_margin") > 0))
    room = F.lit(1) - (F.col("ml_fee_pct") + F.col("tax_pct") + F.col("ads_pct") + F.col("min_viable_margin_pct")) * hundredth
    least = money(F.try_divide((F.col("cost") + fixed).cast("decimal(24,4)"), room.cast("decimal(14,4)")))
    df = df.withColumn("min_price_for_target_margin", F.when(sold & extra & (room > 0), least))
    df = df.withColumns({
        "ads_cost": F.when(F.col("ads_pct") > 0, of("avg_market_price", "ads_pct")),
        "return_rate": F.when(F.col("return_rate_pct") > 0, (F.col("return_rate_pct") * hundredth).try_cast("decimal(5,4)")),
        "packaging_cost": F.when(F.col("packaging_cost_brl") > 0, F.col("packaging_cost_brl")),
        "fulfillment_cost": F.when(F.col("fulfillment_cost_brl") > 0, F.col("fulfillment_cost_brl")),
        "tax_cost": F.when(F.col("tax_pct") > 0, of("avg_market_price", "tax_pct")),
    })
    always = F.lit(True)
    due = {"ml_fee": always, "gross_margin": always, "gross_margin_pct": always, "break_even_price": always, "net_margin": sold & extra, "net_margin_pct": sold & extra, "min_price_for_target_margin": sold & extra & (room > 0), "ads_cost": F.col("ads_pct") > 0, "return_rate": F.col("return_rate_pct") > 0, "tax_cost": F.col("tax_pct") > 0}
    return df, F.filter(F.array(*[F.when(when & F.col(c).isNull(), F.lit(c)) for c, when in due.items()]), lambda c: c.isNotNull())


def margins(df: DataFrame) -> DataFrame:
    """F3 to F10 for rows of cost, avg_market_price and fee columns; fields that don't fit their types are null (see attempt)."""
    return computed(df)[0]


def finance_summary() -> Column:
    """one line on a product's margins."""
    net = F.when(F.col("net_margin_pct").isNotNull(), F.concat(F.lit(" | líquida="), F.col("net_margin_pct").cast("string"), F.lit("% min_preco=R$"), F.coalesce(F.col("min_price_for_target_margin").cast("string"), F.lit("None")))).otherwise("")
    text = [F.when(F.col("is_viable"), "VIÁVEL").otherwise("NÃO VIÁVEL"), F.lit(" | custo=R$"), F.col("cost").cast("string"), F.lit(" preco=R$"), F.col("avg_market_price").cast("string"), F.lit(" taxa=R$"), F.col("ml_fee").cast("string"), F.lit(" bruta="), F.col("gross_margin_pct").cast("string"), F.lit("%"), net]
    return F.concat(*text)


def attempt(products: DataFrame, market: DataFrame, config: FeeConfig = FeeConfig.from_settings()) -> DataFrame:
    """products with a market row, at unit cost, through F2 to F10, in one pass; the market's columns stay.

    fault is null in a good row, else the reason why there is no result and the fields concerned: no_cost, cost_overflow
    (beyond the type of money), non_positive_cost (no catalog's cost, by P2), no_price (a market row without one),
    overflow (fields whose values their types can't hold). One product's fault leaves the others alone.
    """
    priced = products.select("product_id", "catalog_id", "raw_name", F.col("cost").alias("lot_cost"), unit_cost("cost", "raw_name").alias("cost"))
    df, unfit = computed(priced.join(fee_columns(market, config).withColumn("avg_market_price", F.col("avg_price")), "product_id"))
    fault = lambda reason, fields: F.struct(F.lit(reason).alias("reason"), fields.alias("fields"))
    of_ = lambda *names: F.array(*[F.lit(n) for n in names])
    found = (
        F.when(F.col("lot_cost").isNull(), fault("no_cost", of_("cost"))).when(F.col("cost").isNull(), fault("cost_overflow", of_("cost"))).when(F.col("lot_cost") <= 0, fault("non_positive_cost", of_("cost")))
        .when(F.col("avg_market_price").isNull(), fault("no_price", of_("avg_price"))).when(F.size(unfit) > 0, fault("overflow", unfit))
    )
    return df.withColumn("fault", found)


def results(attempted: DataFrame) -> DataFrame:
    """what attempt() has worked out."""
    return attempted.filter("fault IS NULL").drop("fault", "lot_cost")


def quarantine(attempted: DataFrame) -> DataFrame:
    """what attempt() could not work out, with reason and fields."""
    return attempted.filter("fault IS NOT NULL").select("product_id", "catalog_id", "raw_name", F.col("lot_cost").alias("cost"), "avg_price", "fault.reason", "fault.fields")


def analyze(products: DataFrame, market: DataFrame, config: FeeConfig = FeeConfig.from_settings()) -> DataFrame:
    """the good rows of attempt() alone."""
    return results(attempt(products, market, config))
