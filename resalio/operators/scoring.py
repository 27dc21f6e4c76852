"""Scores, classes, explanations, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

SCORE = "decimal(5,2)"
#: Steps of each score, highest first (lowest first for competition), and weights.
DEMAND = [(50000, 100), (20000, 85), (10000, 70), (5000, 55), (2000, 38), (1000, 20)]
MARGIN = [(40, 100), (30, 80), (20, 60), (10, 35)]
COMPETITION = [(3, 100), (8, 90), (15, 75), (25, 55), (40, 35), (60, 18)]
WEIGHTS = {"demand_score": "0.35", "margin_score": "0.40", "competition_score": "0.15", "confidence_score": "0.10"}
CLASS_FROM = [(75, "EXCELENTE"), (55, "BOA"), (35, "ARRISCADA")]


def steps(value: Column, table: list, rest: int, below: bool = False) -> Column:
    found = reduce(lambda w, s: w.when(value <= s[0] if below else value >= s[0], s[1]), table, F)
    return found.otherwise(rest).cast(SCORE)


def demand_score(sold: str = "avg_sold_quantity", listings: str = "listings_above_threshold") -> Column:
    """By units sold; without sales by listings, 50 of them being full."""
    return F.when(F.col(sold) > 0, steps(F.col(sold), DEMAND, 5)).otherwise(F.round(F.least(F.col(listings), F.lit(50)) * 2, 2).cast(SCORE))


def margin_score(pct: str = "gross_margin_pct") -> Column:
    """C2."""
    return F.when(F.col(pct) <= 0, F.lit(0).cast(SCORE)).otherwise(steps(F.col(pct), MARGIN, 10))


def competition_score(sellers: str = "total_sellers") -> Column:
    """Fewer sellers are better."""
    return steps(F.col(sellers), COMPETITION, 5, below=True)


def confidence_score(confidence: str = "avg_match_confidence") -> Column:
    """C4: 100 when unknown."""
    c = F.round(F.col(confidence).cast("decimal(10,4)") * 100, 2)
    return F.when(c.isNull(), 100).otherwise(F.least(F.greatest(c, F.lit(0)), F.lit(100))).cast(SCORE)


def final_score() -> Column:
    """The weighted sum, from 0 to 100, half up."""
    total = reduce(Column.__add__, [F.col(k) * F.lit(w).cast("decimal(3,2)") for k, w in WEIGHTS.items()])
    return F.round(F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("decimal(12,4)"), 2).cast(SCORE)


def classify(score: str = "final_score") -> Column:
    """C6."""
    return reduce(lambda w, s: w.when(F.col(score) >= s[0], s[1]), CLASS_FROM, F).otherwise("EVITAR")


def explanation(viable: str = "is_viable") -> Column:
    """What drives or limits an opportunity."""
    d, m, c = F.col("demand_score"), F.col("margin_score"), F.col("competition_score")
    parts = F.concat_ws(
        ", ",
        F.when(d >= 70, "alta demanda comprovada").when(d >= 40, "demanda moderada").otherwise("demanda limitada"),
        F.when(m >= 80, "margem excelente").when(m >= 60, "boa margem").when(m >= 35, "margem razoável").otherwise("margem baixa"),
        F.when(c >= 75, "baixa concorrência").when(c >= 55, "concorrência moderada").otherwise("alta concorrência"),
        F.when(F.col("confidence_score") < 60, "dados de matching com baixa confiança — verificar manualmente"),
    )
    text = F.concat(F.upper(F.substring(parts, 1, 1)), F.substring(parts, F.lit(2), F.length(parts)), F.lit("."))
    return F.when(F.col(viable), text).otherwise("Produto inviável — o preço médio de mercado não cobre o custo de compra.")


def score(df: DataFrame) -> DataFrame:
    """C1 to C7 for rows with market and finance columns."""
    df = df.withColumns({"demand_score": demand_score(), "margin_score": margin_score(), "competition_score": competition_score(), "confidence_score": confidence_score()})
    df = df.withColumn("final_score", final_score())
    return df.withColumns({"recommendation": classify(), "explanation": explanation()})


def rank(scored: DataFrame, written: bool = False) -> DataFrame:
    """rank_position per catalog, best first, ties by product_id; a catalog of any size is dealt to many tasks. written: scored is a written table, or cheap to read twice."""
    out = numbered(scored, ["catalog_id"], [F.desc("final_score"), F.col("product_id")], "rank_position", written)
    return out.withColumn("rank_position", F.col("rank_position").cast("int"))


def score_catalog(finance: DataFrame, market: DataFrame | None = None, written: bool = False) -> DataFrame:
    """Finance rows with a market row, scored and ranked per catalog. market: where finance lacks its columns."""
    need = ["product_id", "avg_sold_quantity", "listings_above_threshold", "total_sellers", "avg_match_confidence"]
    return rank(score(finance if market is None else finance.join(market.select(*need), "product_id")), written)
