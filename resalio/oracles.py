"""DuckDB SQL for the registered queries: money in whole cents, percentages in hundredths, so that both engines are exact."""

from __future__ import annotations

from .functions import vocabulary as V
from .operators import scoring


def half_up(a: str, b: str) -> str:
    """a / b for whole numbers, b > 0, to the nearest, halves away from zero."""
    return f"(CASE WHEN ({a}) >= 0 THEN (2*({a})+({b}))//(2*({b})) ELSE -((2*(-({a}))+({b}))//(2*({b}))) END)"


def half_even(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


def cents(c: str, name: str | None = None) -> str:
    return f"CAST({c} AS DOUBLE)/100 AS {name or c}"


PRODUCTS = """p AS (
  SELECT p_partkey AS product_id, p_brand AS catalog_id, p_name || ' CX' || p_size AS raw_name, p_type AS category,
    CAST(round(p_retailprice*100) AS BIGINT) AS lot_c, p_size AS units FROM part)"""

LISTINGS = f"""l AS (
  SELECT l_partkey AS product_id, l_orderkey || '-' || l_linenumber AS item_id, CAST(l_quantity*1000 AS BIGINT) AS sold, l_suppkey AS seller_id,
    {half_up("CAST(round(l_extendedprice*100) AS BIGINT)", "CAST(l_quantity AS BIGINT)")} AS price_c, l_returnflag = 'R' AS free,
    CASE WHEN l_linestatus='O' THEN CAST(1000+round(l_discount*100)*100 AS BIGINT) END AS fee_bp, l_orderkey, l_linenumber, l_suppkey,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag) AS position FROM lineitem)"""

PRICES = f"""cut AS (
  SELECT *, CASE WHEN n<=3 OR low+high>=n THEN 0 ELSE low END AS lo, CASE WHEN n<=3 OR low+high>=n THEN n ELSE n-low-high END AS t FROM (
    SELECT *, greatest(1, {half_even("n/10.0")}) AS low, greatest(1, {half_even("n/5.0")}) AS high FROM (
      SELECT product_id, price_c, count(*) OVER (PARTITION BY product_id) AS n, row_number() OVER (PARTITION BY product_id ORDER BY price_c) - 1 AS k FROM l))),
price AS (
  SELECT product_id, {half_even("(max(CASE WHEN k-lo=(t-1)//2 THEN price_c END)+max(CASE WHEN k-lo=t//2 THEN price_c END))/2.0")} AS avg_c,
    max(CASE WHEN k-lo=(CASE WHEN n<=3 THEN 0 ELSE t//4 END) THEN price_c END) AS min_c,
    max(CASE WHEN k-lo=(CASE WHEN n<=3 THEN t-1 ELSE least(t-1, 3*t//4) END) THEN price_c END) AS max_c FROM cut GROUP BY product_id)"""

MARKET = f"""m AS (
  SELECT f.*, avg_c, min_c, max_c FROM (
    SELECT product_id, count(DISTINCT nullif(seller_id,0)) AS sellers, count(*) AS n, 1000 AS conf, CAST(sum(sold) AS BIGINT)//count(*) AS avg_sold, CAST(sum(sold) AS BIGINT) AS total_sold,
      {half_even("CAST(sum(fee_bp) AS DOUBLE)/count(fee_bp)")} AS fee_bp, {half_even("CAST(sum(CASE WHEN free THEN 10000 ELSE 0 END) AS DOUBLE)/count(*)")} AS free_bp
    FROM l GROUP BY product_id) f JOIN price USING (product_id))"""

FINANCE = f"""f0 AS (
  SELECT p.product_id, catalog_id, {half_up("lot_c", "units")} AS cost_c, avg_c AS price_c, avg_c>0 AS sold, coalesce(fee_bp,1100) AS fee_bp, CASE WHEN free_bp<=5000 THEN 0 ELSE 2000 END AS fixed_c, m.* EXCLUDE (product_id, fee_bp)
  FROM p JOIN m USING (product_id)),
f1 AS (SELECT *, {half_up("price_c*fee_bp", "10000")} AS ml_fee_c, {half_up("price_c*700", "10000")} AS tax_c FROM f0),
f2 AS (SELECT *, price_c-cost_c-ml_fee_c AS gross_c, CASE WHEN sold THEN {half_up("cost_c*10000", "10000-fee_bp")} ELSE cost_c END AS even_c FROM f1),
f3 AS (SELECT *, CASE WHEN sold THEN {half_up("gross_c*10000", "price_c")} ELSE 0 END AS gross_bp, CASE WHEN sold AND even_c>0 THEN least({half_up("(price_c-even_c)*10000", "even_c")}, 99999) ELSE 0 END AS safety_bp, CASE WHEN sold THEN gross_c-fixed_c-tax_c END AS net_c FROM f2),
f4 AS (SELECT *, CASE WHEN sold THEN {half_up("net_c*10000", "price_c")} END AS net_bp, CASE WHEN sold AND fee_bp+2700<10000 THEN {half_up("(cost_c+fixed_c)*10000", "10000-fee_bp-2700")} END AS least_c FROM f3),
f AS (SELECT *, sold AND net_bp>=2000 AS is_viable FROM f4)"""


def ladder(value: str, steps: list, rest: int, sign: str = ">=", times: int = 1) -> str:
    return "CASE " + " ".join(f"WHEN {value} {sign} {a * times} THEN {b}" for a, b in steps) + f" ELSE {rest} END"


SCORES = f"""s0 AS (
  SELECT *, CASE WHEN avg_sold>0 THEN {ladder("avg_sold", scoring.DEMAND, 5)} ELSE least(n,50)*2 END AS ds,
    CASE WHEN gross_bp<=0 THEN 0 ELSE {ladder("gross_bp", scoring.MARGIN, 10, times=100)} END AS ms, {ladder("sellers", scoring.COMPETITION, 5, "<=")} AS cs FROM f),
s1 AS (SELECT *, 35*ds+40*ms+15*cs+least(greatest(conf, 0), 1000) AS final_c FROM s0),
s AS (SELECT *, CASE WHEN final_c>=7500 THEN 'EXCELENTE' WHEN final_c>=5500 THEN 'BOA' WHEN final_c>=3500 THEN 'ARRISCADA' ELSE 'EVITAR' END AS recommendation,
  CAST(row_number() OVER (PARTITION BY catalog_id ORDER BY final_c DESC, product_id) AS INTEGER) AS rank_position,
  CASE WHEN NOT is_viable THEN 'Produto inviável — o preço médio de mercado não cobre o custo de compra.' ELSE
    CASE WHEN ds>=70 THEN 'Alta demanda comprovada' WHEN ds>=40 THEN 'Demanda moderada' ELSE 'Demanda limitada' END || ', ' ||
    CASE WHEN ms>=80 THEN 'margem excelente' WHEN ms>=60 THEN 'boa margem' WHEN ms>=35 THEN 'margem razoável' ELSE 'margem baixa' END || ', ' ||
    CASE WHEN cs>=75 THEN 'baixa concorrência' WHEN cs>=55 THEN 'concorrência moderada' ELSE 'alta concorrência' END || CASE WHEN conf<600 THEN ', dados de matching com baixa confiança — verificar manualmente' ELSE '' END || '.' END AS explanation FROM s1)"""

TO_LISTINGS = "WITH " + LISTINGS
TO_MARKET = ",\n".join([TO_LISTINGS, PRICES, MARKET])
TO_FINANCE = ",\n".join([TO_MARKET, PRODUCTS, FINANCE])
TO_SCORES = ",\n".join([TO_FINANCE, SCORES])
OPPORTUNITY = f"product_id, s.catalog_id, raw_name, {cents('final_c', 'final_score')}, rank_position, recommendation, {cents('avg_c', 'avg_price')}, {cents('gross_bp', 'gross_margin_pct')}, {cents('net_bp', 'net_margin_pct')}, is_viable, explanation"


def replaced(x: str, pattern: str, by: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{quoted}', '{by}', 'g')"


def squeeze(x: str) -> str:
    return f"trim({replaced(x, chr(92) + 's+', ' ')})"


def bare(x: str) -> str:
    return replaced(f"translate({x}, '{V.ACCENTED}', '{V.BARE}')", r"\pM", "")


def norm(x: str) -> str:
    y = f"lower({bare(f'coalesce({x}, {chr(39) * 2})')})"
    y = replaced(y, r"(\d)(ml|kg|g|w|v|cm|mm|m|l)(\s|$)", r"\1 \2\3")
    y = replaced(y, r"(\b\d+)\s+l\b", r"\1 litro")
    y = replaced(y, r"[^a-z0-9\s]", " ")
    for pattern, word in V.SYNONYMS:
        y = replaced(y, pattern, word)
    return squeeze(y)


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


def tokens(x: str) -> str:
    high, small = listed(V.HIGH_WEIGHT), listed(V.SIZES)
    kept = f"t <> '' AND NOT list_contains({listed(V.STOP_WORDS)}, t) AND NOT (length(t)=1 AND NOT list_contains({small}, t) AND NOT regexp_matches(t, '^[0-9]+$')) AND NOT (regexp_matches(t, '^[0-9]+$') AND length(ltrim(t,'0'))>3)"
    single = f"CASE WHEN length(t)>4 AND t LIKE '%s' AND t NOT LIKE '%ss' AND list_contains({high}, left(t, length(t)-1)) THEN left(t, length(t)-1) ELSE t END"
    return f"list_transform(list_filter(string_split({x}, ' '), lambda t: {kept}), lambda t: {single})"


def weight(x: str) -> str:
    """The weight of a list of distinct tokens."""
    return f"coalesce(list_sum(list_transform({x}, lambda t: CASE WHEN list_contains({listed(V.HIGH_WEIGHT)}, t) THEN 2.0 ELSE 1.0 END)), 0)"


def jaccard(a: str, b: str) -> str:
    both = f"list_distinct(list_concat({a}, {b}))"
    return f"CASE WHEN len({a})=0 OR len({b})=0 THEN 0.0 ELSE CAST({weight(f'list_distinct(list_intersect({a}, {b}))')} AS DOUBLE)/CAST({weight(both)} AS DOUBLE) END"


SHEET = """sheet AS (
  SELECT CAST(l_orderkey//64 AS VARCHAR) AS catalog_id, CAST(row_number() OVER (PARTITION BY l_orderkey//64 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag) AS INTEGER) AS row_idx,
    CASE WHEN l_linenumber=1 THEN l_returnflag END AS category, CAST(l_partkey%50 AS VARCHAR) AS sku, l_quantity>25 AS blank FROM lineitem)"""


def match_sql() -> str:
    """Scores of pairs(): kits, voltages, sizes, volumes and units as its names are made."""
    lv = "CASE b.p_size%3 WHEN 0 THEN '220' WHEN 1 THEN 'bivolt' END"
    return f"""WITH part_names AS (SELECT p_partkey, p_size, {norm("p_name || ' ' || p_size || 'ml 110v'")} AS cn, {norm("p_name || ' Kit ' || p_size || 'ml ' || CASE WHEN p_size%3=0 THEN '220v' WHEN p_size%3=1 THEN 'bivolt' ELSE 'p' END")} AS ln FROM part),
    t AS (SELECT *, {tokens("cn")} AS ct, {tokens("ln")} AS lt FROM part_names),
    pair AS (SELECT DISTINCT x.l_partkey AS product_id, y.l_partkey AS other FROM lineitem x JOIN lineitem y ON x.l_orderkey=y.l_orderkey AND y.l_linenumber=x.l_linenumber+1),
    scored AS (SELECT product_id, other, {jaccard("a.ct", "b.lt")} AS base, 0.65 AS kit, CASE WHEN {lv}='220' THEN 0.90 ELSE 0.0 END AS volt, CASE WHEN {lv}='bivolt' THEN 0.15 ELSE 0.0 END AS boost,
      CASE WHEN CAST(a.p_size AS DOUBLE)/b.p_size<0.75 OR CAST(a.p_size AS DOUBLE)/b.p_size>1.33 THEN 0.60 ELSE 0.0 END AS vol FROM pair JOIN t a ON a.p_partkey=product_id JOIN t b ON b.p_partkey=other)
    SELECT product_id, other, round_even(least(greatest(base*(1-least(CAST(kit AS DOUBLE)+CAST(volt AS DOUBLE)+CAST(vol AS DOUBLE),1.0))+CAST(boost AS DOUBLE),0.0),1.0), 4) AS match_score, round_even(base, 6) AS match_base,
      concat_ws(',', 'kit', CASE WHEN volt>0 THEN 'voltagem' END, CASE WHEN vol>0 THEN 'volume' END, CASE WHEN boost>0 THEN 'bivolt' END) AS reasons FROM scored"""


def decimal(c: str) -> str:
    """Cents as text with two places."""
    return f"CAST(CAST({c} AS DECIMAL(18,0))*0.01 AS VARCHAR)"


SUMMARY = f"CASE WHEN is_viable THEN 'VIÁVEL' ELSE 'NÃO VIÁVEL' END||' | custo=R$'||{decimal('cost_c')}||' preco=R$'||{decimal('price_c')}||' taxa=R$'||{decimal('ml_fee_c')}||' bruta='||{decimal('gross_bp')}||'%'||CASE WHEN net_bp IS NULL THEN '' ELSE ' | líquida='||{decimal('net_bp')}||'% min_preco=R$'||coalesce({decimal('least_c')}, 'None') END"


def filter_sql(where: str) -> str:
    return f"{TO_SCORES} SELECT product_id, catalog_id, {cents('final_c', 'final_score')}, recommendation, rank_position, is_viable, {cents('gross_bp', 'gross_margin_pct')}, n AS listings_above_threshold FROM s WHERE {where}"


def sql() -> dict[str, str]:
    counts = " UNION ALL ".join(f"SELECT catalog_id, '{c}' AS recommendation, count(*) FILTER (WHERE recommendation='{c}') AS products FROM s GROUP BY catalog_id" for c in V.CLASSES)
    coverage = ", ".join(f"{n}, round_even(CAST({n} AS DOUBLE)/products*100, 1) AS {n}_pct" for n in ("market", "finance", "scores"))
    name = "p_name || ' CX' || p_size"
    named = replaced(norm(name), V.PACKAGING.replace("(?i)", ""), " ")
    return {
        "opportunities": f"{TO_SCORES} SELECT {OPPORTUNITY} FROM s JOIN p USING (product_id)",
        "opportunities_excellent": f"{TO_SCORES} SELECT {OPPORTUNITY} FROM s JOIN p USING (product_id) WHERE recommendation='EXCELENTE' AND final_c>=6000",
        "opportunity_listings": f"{TO_SCORES} SELECT product_id, rank_position, count(*) AS n_listings, string_agg(item_id, ',' ORDER BY position) AS item_ids FROM s JOIN l USING (product_id) WHERE position<=5 GROUP BY ALL",
        "opportunity_filter": filter_sql("is_viable"),
        "opportunity_filter_good": filter_sql("is_viable AND final_c>=5500 AND gross_bp>=1000 AND recommendation IN ('EXCELENTE','BOA')"),
        "market_competitive_price": f"{TO_LISTINGS}, {PRICES} SELECT product_id, {cents('avg_c', 'avg_price')}, {cents('min_c', 'min_price')}, {cents('max_c', 'max_price')} FROM price",
        "market_analysis": f"{TO_MARKET} SELECT product_id, {cents('avg_c', 'avg_price')}, {cents('min_c', 'min_price')}, {cents('max_c', 'max_price')}, sellers AS total_sellers, n AS total_listings_found, avg_sold AS avg_sold_quantity, total_sold AS total_sold_quantity, {cents('fee_bp', 'avg_ml_fee_pct')}, {cents('free_bp', 'free_shipping_pct')} FROM m",
        "sales_filter": f"{TO_LISTINGS} SELECT product_id, count(*) AS n, CAST(sum(sold) AS BIGINT) AS sold FROM (SELECT *, max(sold) OVER (PARTITION BY product_id) AS most FROM l) WHERE sold>=45000 OR most<45000 GROUP BY product_id",
        "top_listings": f"{TO_LISTINGS} SELECT product_id, CAST(position AS INTEGER) AS rank_position, item_id, {cents('price_c', 'price')}, nullif(sold,0) AS sold_quantity, seller_id FROM l WHERE position<=5",
        "enrich_capped": f"{TO_LISTINGS} SELECT product_id, item_id, CASE WHEN hit AND seller_id=0 THEN max(seller_id) OVER (PARTITION BY item_id) ELSE seller_id END AS seller_id, CASE WHEN hit THEN max(sold) OVER (PARTITION BY item_id)//1000*7 ELSE sold END AS sold_quantity, CASE WHEN hit THEN 'new' ELSE '' END AS condition, hit OR free AS free_shipping, CASE WHEN hit THEN 'c1' ELSE '' END AS category_id FROM (SELECT *, position<=20 AND l_linenumber%2=1 AS hit FROM l)",
        "pending_products": f"{TO_LISTINGS}, {PRODUCTS} SELECT product_id, catalog_id FROM p WHERE product_id NOT IN (SELECT product_id FROM l GROUP BY product_id HAVING count(*)>30)",
        "finance_summary": f"{TO_FINANCE} SELECT product_id, {SUMMARY} AS summary FROM f",
        "finance": f"{TO_FINANCE} SELECT product_id, {cents('cost_c', 'cost')}, {cents('price_c', 'avg_market_price')}, {cents('ml_fee_c', 'ml_fee')}, {cents('gross_c', 'gross_margin')}, {cents('gross_bp', 'gross_margin_pct')}, {cents('even_c', 'break_even_price')}, {cents('safety_bp', 'price_safety_margin_pct')}, {cents('net_c', 'net_margin')}, {cents('net_bp', 'net_margin_pct')}, is_viable, {cents('least_c', 'min_price_for_target_margin')}, {cents('tax_c', 'tax_cost')}, CAST(nullif(fixed_c,0) AS DOUBLE)/100 AS fulfillment_cost FROM f",
        "scores": f"{TO_SCORES} SELECT product_id, catalog_id, CAST(ds AS DOUBLE) AS demand_score, CAST(ms AS DOUBLE) AS margin_score, CAST(cs AS DOUBLE) AS competition_score, CAST(conf AS DOUBLE)/10 AS confidence_score, {cents('final_c', 'final_score')}, recommendation, rank_position FROM s",
        "explanation": f"{TO_SCORES} SELECT product_id, explanation FROM s",
        "recommendation_counts": f"{TO_SCORES} {counts}",
        "pipeline_coverage": f"""{TO_SCORES} SELECT catalog_id, products, {coverage}, CASE WHEN products=0 THEN 'PARSING' WHEN market=0 THEN 'MARKET' WHEN finance=0 THEN 'FINANCE' WHEN scores=0 THEN 'SCORING' WHEN scores<products THEN 'PARTIAL' ELSE 'OK' END AS bottleneck
            FROM (SELECT p.catalog_id, count(*) AS products, count(*) FILTER (WHERE s.sellers>0) AS market, count(*) FILTER (WHERE s.is_viable) AS finance, count(*) FILTER (WHERE s.final_c>=7500) AS scores FROM p LEFT JOIN s USING (product_id) GROUP BY p.catalog_id)""",
        "dashboard_view": f"{TO_SCORES} SELECT product_id, CASE WHEN gross_bp>=2000 THEN 'high' WHEN gross_bp>=1000 THEN 'medium' ELSE 'low' END AS margin_band, free_bp>5000 AS mostly_free_shipping, {cents('price_c', 'effective_price')} FROM s",
        "price_parse": """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey%5<3 THEN CAST(c AS DOUBLE)/100 WHEN l_orderkey%5=3 OR c//100>=1000 THEN CAST(c//100 AS DOUBLE) WHEN c>=100 THEN CAST(c//100 AS DOUBLE)/1000 END AS price FROM (SELECT *, CAST(round(l_extendedprice*100) AS BIGINT) AS c FROM lineitem)""",
        "names": f"""SELECT p_partkey AS product_id, {name} AS raw_name, {norm(name)} AS norm, array_to_string({tokens(norm(name))}, ' ') AS tokens,
            array_to_string(list_slice({tokens(squeeze(named))}, 1, 6), ' ') AS search_query, CAST(p_size AS INTEGER) AS units, CAST({half_up("CAST(round(p_retailprice*100) AS BIGINT)", "p_size")} AS DOUBLE)/100 AS unit_cost FROM part""",
        "norm_documents": f"SELECT doc_id, {norm('text')} AS norm, {squeeze(f'lower({bare(chr(116) + chr(101) + chr(120) + chr(116))})')} AS header FROM documents",
        "match_score": match_sql(),
        "token_candidates": f"""WITH a AS (SELECT min(p_partkey) AS product_id, {tokens(norm("p_name || ' ' || p_type"))} AS ct FROM part GROUP BY p_name, p_type), b AS (SELECT min(p_partkey) AS item_id, {tokens(norm("p_name || ' ' || p_brand"))} AS lt FROM part GROUP BY p_name, p_brand)
            SELECT * FROM (SELECT product_id, item_id, round_even({jaccard("ct", "lt")}, 6) AS jaccard FROM a, b) WHERE jaccard>=0.5""",
        "category_fill": f"WITH {SHEET} SELECT catalog_id, row_idx, last_value(category IGNORE NULLS) OVER (PARTITION BY catalog_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS category FROM sheet",
        "dup_sku": f"WITH {SHEET} SELECT catalog_id, count(*) AS n_rows, count(*)-count(DISTINCT sku) AS duplicates FROM sheet GROUP BY catalog_id",
        "blank_run_cut": f"""WITH {SHEET}, r AS (SELECT *, blank AND lag(blank,1,false) OVER w AND lag(blank,2,false) OVER w AS third FROM sheet WINDOW w AS (PARTITION BY catalog_id ORDER BY row_idx)),
            z AS (SELECT catalog_id, min(CASE WHEN third THEN row_idx END) AS stop FROM r GROUP BY catalog_id) SELECT catalog_id, count(*) AS n_rows, max(row_idx) AS last_row FROM sheet JOIN z USING (catalog_id) WHERE stop IS NULL OR row_idx<=stop GROUP BY catalog_id""",
        "page_slugs": """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[^\\pL\\pN_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
            CASE WHEN mil<>'' THEN TRY_CAST(mil AS BIGINT)*1000 WHEN first<>'' THEN TRY_CAST(first AS BIGINT) ELSE 0 END AS sold FROM (SELECT *, regexp_extract(u, '(\\d+)\\s*mil', 1) AS mil, regexp_extract(u, '(\\d+)', 1) AS first FROM (SELECT *, lower(translate(url, '.,', '')) AS u FROM pages))""",
        "upsert": f"{TO_MARKET} SELECT product_id, CASE WHEN n>30 THEN 0.0 ELSE CAST(avg_c AS DOUBLE)/100 END AS avg_price FROM m UNION ALL SELECT -1-product_id, CAST(avg_c AS DOUBLE)/100 FROM m WHERE n<=20",
        "replace_children": f"{TO_LISTINGS} SELECT product_id, CAST(position AS INTEGER) AS rank_position, CASE WHEN product_id%3=0 THEN 'new' ELSE item_id END AS item_id FROM l WHERE position<=5 AND (product_id%3<>0 OR position=1)",
        "keyed_upsert": f"{TO_MARKET} SELECT product_id, CASE WHEN n>30 THEN 0.0 ELSE CAST(avg_c AS DOUBLE)/100 END AS avg_price FROM m UNION ALL SELECT -1-product_id, CAST(avg_c AS DOUBLE)/100 FROM m WHERE n<=20",
        "keyed_children": f"{TO_LISTINGS} SELECT product_id, CAST(position AS INTEGER) AS rank_position, CASE WHEN product_id%3=0 THEN 'new' ELSE item_id END AS item_id FROM l WHERE position<=5 AND (product_id%3<>0 OR position=1) AND product_id%7<>1",
    }
