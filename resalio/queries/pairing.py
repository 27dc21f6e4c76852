"""Queries on matching (M2 to M14), and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import matching as M
from ..oracles import jaccard, listed, norm, tokens
from ..sources import driver
from ..sources.shared import materialize

UNITS, SIZES, KITS, VOLTS = ["ml", "kg", "g", "litro", "cm"], ["P", "G", "m", "", "gg", ""], ["Kit ", "Kit 3 ", "", "", "Caixa com 10 "], ["110v", "220v", "bivolt", "", "127 V"]


def pick(words: list[str], number) -> F.Column:
    return F.array(*[F.lit(w) for w in words])[(number % len(words)).cast("int")]


def marked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts bought in one order, as a product and a listing whose amounts, sizes, voltages and kits differ or not, scored."""
    part = driver.read(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    left = F.concat_ws(" ", "p_name", F.concat(s.cast("string"), pick(UNITS, k)), pick(VOLTS, F.floor(k / 7)), pick(SIZES, F.floor(k / 3)))
    right = F.concat_ws(" ", F.concat(pick(KITS, F.floor(k / 5)), F.col("p_name")), F.concat(s.cast("string"), F.lit(",5 "), pick(UNITS, F.floor(k / 2))), pick(VOLTS, k), pick(SIZES, k))
    a = M.prepare(part.select(k.alias("product_id"), left.alias("name")), "name", "catalog")
    b = M.prepare(part.select(k.alias("item_id"), right.alias("title")), "title", "listing")
    line = driver.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("item_id"))
    both = line.join(after, ["l_orderkey", "l_linenumber"]).groupBy(F.col("l_partkey").alias("product_id"), "item_id").agg((F.max("l_quantity") * 100).cast("long").alias("sold_quantity"))
    return M.score_pairs(both, a, b)


def match_marks(spark: SparkSession, d: str) -> DataFrame:
    return marked_pairs(spark, d).select("product_id", "item_id", F.bround("match_base", 6).alias("match_base"), "match_score", "match_tier", F.array_join("match_reasons", ",").alias("reasons"))


def qualified_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.qualify(marked_pairs(spark, d), 2000, 0.2).select("product_id", "item_id", "match_score")


def qualify_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.qualify_stats(marked_pairs(spark, d), "product_id", min_sales=2000, min_confidence=0.0)


def phases(spark: SparkSession, d: str, retry_empty: bool = True) -> DataFrame:
    """Parts ask for their name within a block of 200 parts and a kind; some kinds have listings of their own, and blocks have some under the shorter query."""
    part, block = driver.read(spark, d, "part"), F.concat(F.lit("b"), F.translate(F.floor(F.col("p_partkey") / 200).cast("string"), "0123456789", "abcdefghij"))
    size = F.concat(F.col("p_size").cast("string"), F.lit("ml"))
    asked = part.select(F.col("p_partkey").alias("product_id"), F.concat_ws(" ", "p_name", block, "p_type").alias("query"), F.concat_ws(" ", "p_name", block, "p_type", size).alias("name"))
    long, short = F.upper(F.concat_ws(" ", "p_name", block, "p_type")), F.concat_ws(" ", "p_name", block)
    kind = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), long).when(F.col("p_size") % 2 == 0, short)
    found = part.select(kind.alias("query"), F.col("p_partkey").alias("item_id"), F.concat_ws(" ", F.when(F.col("p_size") % 7 == 0, "Kit 2"), "p_name", block, "p_type", size).alias("title"), (F.col("p_size") * 100).cast("long").alias("sold_quantity")).filter("query IS NOT NULL")
    return M.two_phase_match(M.prepare(asked, "name", "catalog"), M.prepare(found, "title", "listing"), 500, 0.55, retry_empty)


def two_phase(spark: SparkSession, d: str) -> DataFrame:
    return phases(spark, d).select("product_id", "item_id", "match_score", F.col("phase").cast("long").alias("phase"))


def two_phase_once(spark: SparkSession, d: str) -> DataFrame:
    """M13 for a feed that doesn't ask again for products without any result."""
    return phases(spark, d, False).select("product_id", "item_id", "match_score", F.col("phase").cast("long").alias("phase"))


def match_quality(spark: SparkSession, d: str) -> DataFrame:
    return M.match_quality(materialize(phases(spark, d), "matches"))


QUERIES = {"match_marks": match_marks, "qualified_pairs": qualified_pairs, "qualify_stats": qualify_stats, "two_phase_match": two_phase, "two_phase_once": two_phase_once, "match_quality": match_quality}


def picked(words: list[str], number: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({number})%{len(words)}+1]"


def side(table: str, key: str, name: str, x: str) -> str:
    """A CTE of what a side's names tell, by columns that begin with x."""
    n = f"{x}n"
    family = " ".join(f"WHEN regexp_matches({n}, '{p}') THEN {k}" for k, p in enumerate(V.UNIT_FAMILIES))
    volts = " ".join(f"WHEN regexp_matches({n}, '{p}') THEN '{v}'" for v, p in V.VOLTAGES)
    amounts = f"list_transform(list_zip(regexp_extract_all({n}, '{V.AMOUNT}', 1), regexp_extract_all({n}, '{V.AMOUNT}', 2)), lambda z: CAST(z[1] AS DOUBLE)*CASE WHEN z[2] IN ('l', 'litro', 'litros', 'kg') THEN 1000 ELSE 1 END)"
    return f"""{x} AS (SELECT *, list_filter({x}t, lambda t: list_contains({listed(V.SIZES)}, t)) AS {x}s, regexp_matches({n}, '{V.KIT}') AS {x}k, regexp_matches({n}, '{V.COUNTED_KIT}') AS {x}c, CASE {volts} END AS {x}v, CASE {family} END AS {x}f, list_max({amounts}) AS {x}a
        FROM (SELECT *, {tokens(n)} AS {x}t FROM (SELECT *, {norm(name)} AS {n} FROM {table})))"""


SCORED = f"""SELECT *, CASE WHEN len(pt)=0 OR len(qt)=0 THEN 0.0 ELSE least(greatest(base*(1-least(kit+volt+size+unit+vol, 1.0))+boost, 0.0), 1.0) END AS raw FROM (
    SELECT *, {jaccard("pt", "qt")} AS base, CASE WHEN qk AND NOT pk THEN CASE WHEN qc THEN 0.65 ELSE 0.40 END ELSE 0.0 END::DOUBLE AS kit, CASE WHEN pv<>qv AND NOT (pv='bivolt' OR qv='bivolt') THEN 0.90 ELSE 0.0 END::DOUBLE AS volt,
      CASE WHEN pv<>qv AND (pv='bivolt' OR qv='bivolt') THEN 0.15 ELSE 0.0 END::DOUBLE AS boost, CASE WHEN len(ps)>0 AND len(qs)>0 AND NOT list_has_any(ps, qs) THEN 0.70 ELSE 0.0 END::DOUBLE AS size,
      CASE WHEN pf<>qf THEN 0.80 ELSE 0.0 END::DOUBLE AS unit, CASE WHEN pa>0 AND qa>0 AND (pa/qa<0.75 OR pa/qa>1.33) THEN 0.60 ELSE 0.0 END::DOUBLE AS vol FROM pair)"""


def sql() -> dict[str, str]:
    left = f"concat_ws(' ', p_name, p_size||{picked(UNITS, 'p_partkey')}, {picked(VOLTS, 'p_partkey//7')}, {picked(SIZES, 'p_partkey//3')})"
    right = f"concat_ws(' ', {picked(KITS, 'p_partkey//5')}||p_name, p_size||',5 '||{picked(UNITS, 'p_partkey//2')}, {picked(VOLTS, 'p_partkey')}, {picked(SIZES, 'p_partkey')})"
    marks = f"""WITH l AS (SELECT p_partkey AS product_id, {left} AS name FROM part), r AS (SELECT p_partkey AS item_id, {right} AS title FROM part), {side("l", "product_id", "name", "p")}, {side("r", "item_id", "title", "q")},
      pair AS (SELECT * FROM (SELECT x.l_partkey AS product_id, y.l_partkey AS item_id, CAST(max(x.l_quantity)*100 AS BIGINT) AS sold_quantity FROM lineitem x JOIN lineitem y ON x.l_orderkey=y.l_orderkey AND y.l_linenumber=x.l_linenumber+1 GROUP BY 1, 2) JOIN p USING (product_id) JOIN q USING (item_id)),
      scored AS (SELECT *, round_even(raw, 4) AS match_score FROM ({SCORED}))"""
    block = "'b'||translate(CAST(p_partkey//200 AS VARCHAR), '0123456789', 'abcdefghij')"
    two = f"""WITH asked AS (SELECT p_partkey AS product_id, lower(p_name||' '||{block}||' '||p_type) AS long, lower(p_name||' '||{block}) AS short, p_name||' '||{block}||' '||p_type||' '||p_size||'ml' AS name FROM part),
      r AS (SELECT * FROM (SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN lower(p_name||' '||{block}||' '||p_type) WHEN p_size%2=0 THEN lower(p_name||' '||{block}) END AS query, p_partkey AS item_id, CASE WHEN p_size%7=0 THEN 'Kit 2 ' ELSE '' END||p_name||' '||{block}||' '||p_type||' '||p_size||'ml' AS title, p_size*100 AS sold_quantity FROM part) WHERE query IS NOT NULL),
      {side("asked", "product_id", "name", "p")}, {side("r", "item_id", "title", "q")},
      pair AS (SELECT p.*, q.*, CASE WHEN query=long THEN 1 ELSE 2 END AS phase FROM p JOIN q ON query=long OR query=short),
      scored AS (SELECT *, round_even(raw, 4) AS match_score FROM ({SCORED})),
      first AS (SELECT * FROM scored WHERE phase=1 AND sold_quantity>=500 AND match_score>=0.55),
      kept AS (SELECT * FROM first UNION ALL SELECT * FROM scored WHERE phase=2 AND sold_quantity>=500 AND match_score>=0.65 AND product_id NOT IN (SELECT product_id FROM first))"""
    tier = "CASE WHEN raw>=0.8 THEN 'HIGH' WHEN raw>=0.5 THEN 'MEDIUM' ELSE 'LOW' END"
    named = {"kit": "kit", "volt": "voltagem", "size": "tamanho", "unit": "unidade", "vol": "volume", "boost": "bivolt"}
    reasons = "concat_ws(',', " + ", ".join(f"CASE WHEN {c}>0 THEN '{w}' END" for c, w in named.items()) + ")"
    return {
        "match_marks": f"{marks} SELECT product_id, item_id, round_even(base, 6) AS match_base, match_score, {tier} AS match_tier, {reasons} AS reasons FROM scored",
        "qualified_pairs": f"{marks} SELECT product_id, item_id, match_score FROM scored WHERE sold_quantity>=2000 AND match_score>=0.2",
        "qualify_stats": f"{marks} SELECT product_id, count(*) FILTER (WHERE sold_quantity<2000) AS discarded_low_sales, count(*) FILTER (WHERE sold_quantity>=2000 AND match_score<0.5) AS discarded_low_match, count(*) FILTER (WHERE sold_quantity>=2000 AND match_score>=0.5) AS qualified FROM scored GROUP BY product_id",
        "two_phase_match": f"{two} SELECT product_id, item_id, match_score, phase FROM kept",
        "two_phase_once": f"{two} SELECT product_id, item_id, match_score, phase FROM kept WHERE phase=1 OR product_id IN (SELECT product_id FROM scored WHERE phase=1)",
        "match_quality": f"{two} SELECT product_id, count(*) FILTER (WHERE raw>=0.8) AS high_matches, count(*) FILTER (WHERE raw>=0.5 AND raw<0.8) AS medium_matches, round_even(avg(match_score), 3) AS avg_score, CAST(sum(sold_quantity) AS BIGINT) AS total_sold FROM kept GROUP BY product_id",
    }
