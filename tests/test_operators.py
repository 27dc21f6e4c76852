"""Catalog operators on hand-written rows and against plain models."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from resalio.functions import price as P
from resalio.functions import text as T
from resalio.operators import finance, headers, market, matching, ordering, reports, rows, scoring, selection
from resalio.plans import catalogs
from resalio.sources import csv_files, feeds, markup, shared, sinks
from resalio.streaming import catalogs as streaming


def one(spark, column, *values, kind="string"):
    """The column's value for each value of x."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").repartition(2)
    return [r.y for r in df.select("k", column.alias("y")).orderBy("k").collect()]


def test_text(spark):
    assert one(spark, T.norm_match("x"), "Luva VINIL 500ml", "Água 1l", "Cabo USB Tipo C 2 metros", "Fone BT sem fio", None) == ["luva vinil 500 ml", "agua 1 l", "cabo usbc 2 m", "fone bluetooth wireless", ""]
    assert one(spark, T.norm_header("x"), " Preço  de CUSTO ", "DESCRIÇÃO") == ["preco de custo", "descricao"]
    assert one(spark, T.tokens("x"), "Luvas de Vinil P 1000 un", "kit 50 menos") == [["luva", "vinil", "p", "un"], ["kit", "50"]]
    assert one(spark, T.search_query("x"), "10001 - LUVA VINIL P CX100", "LEITE CONDENSADO MOCA 395G CX24", "OLEO SOJA 900ML 100 un", "de da") == ["luva vinil p", "leite condensado moca 395 g", "oleo soja 900 ml", "de da"]
    assert one(spark, T.clean_text("x"), " a\n b ", "N/A", "-", None) == ["a b", None, None, None]
    assert one(spark, T.item_id("x"), "https://x/MLB-4290861023-a", "mlb77", "none") == ["MLB4290861023", "MLB77", None]
    assert one(spark, T.simplify_query("x"), "a b c d", "a b") == ["a b c", "a b"]
    assert one(spark, T.format_brl("x"), Decimal("1234.56"), kind="decimal(12,2)") == ["R$ 1.234,56"]
    assert one(spark, T.query_slug("x"), " Luva de_Vinil! P ") == ["luva-de-vinil-p"]
    assert one(spark, T.logistic_label("x"), "fulfillment", "other") == ["Full", "other"]


@pytest.mark.parametrize(
    "raw, value",
    [("R$ 1.234,56", "1234.56"), ("R$50,00", "50"), ("1234.56", "1234.56"), ("50,00", "50"), ("1.234", "1234"), ("1,234.56", "1234.56"), ("1.234.567", "1234567"), ("1,234,56", "1234.56"),
     ("0,500", "500"), ("0.500", "0.5"), ("abc", None), ("", None), ("-5", None), ("0", None), ("12,5", "12.5")],
)
def test_prices(spark, raw, value):
    assert one(spark, P.parse_price("x"), raw)[0] == (None if value is None else Decimal(value))


def test_other_prices(spark):
    assert one(spark, P.parse_feed_price("x"), "1.234", "1.234,56", "173,76", "x") == [Decimal("1.23"), Decimal("1234.56"), Decimal("173.76"), None]
    assert one(spark, P.parse_page_price("x"), "1.234", "R$ 12,5", "x") == [Decimal(1234), Decimal("12.5"), Decimal(0)]
    assert one(spark, P.parse_sold("x"), "+1,5 mil vendidos", "+500 vendidos", "novo") == [15000, 500, 0]
    assert one(spark, P.units_per_package("x"), "LUVA CX100", "FARDO 30", "C/ 24", "12x1", "700 x 350 mm", "solo") == [100, 30, 24, 12, 1, 1]


PAIRS = [
    ("Luva de Vinil P", "Kit 100 Luvas Vinil P", 0, 0.5, "kit"),
    ("Secador Cabelo 1800W 110v", "Secador Cabelo 1800W 220v", 0, 0.2, "voltagem"),
    ("Secador 1800W 110v", "Secador 1800W Bivolt", 0.6, 1, "bivolt"),
    ("Luva Nitrilo P", "Luva Nitrilo G", 0, 0.45, "tamanho"),
    ("Frasco Shampoo 500ml", "Frasco Shampoo 1 Litro", 0, 0.55, "volume"),
    ("Produto A 1kg", "Produto A 1 Litro", 0, 0.6, "unidade"),
    ("Luva Vinil", "Luvas de Vinil", 1, 1, None),
    ("", "Luva", 0, 0, None),
]


def test_match_scores(spark):
    df = spark.createDataFrame([(k, *p[:2]) for k, p in enumerate(PAIRS)], "k int, a string, b string")
    scored = matching.match_score(matching.prepare(matching.prepare(df, "a", "catalog"), "b", "listing")).orderBy("k").collect()
    for r, (_, _, low, high, reason) in zip(scored, PAIRS):
        assert low <= r.match_score <= high and (reason is None or reason in r.match_reasons), r


def test_candidates_lose_no_pair(spark):
    rng = random.Random(7)
    words = ["luva", "vinil", "caixa", "azul", "verde", "grande", "mini", "extra", "super", "forte"]
    side = lambda n: [(k, sorted(rng.sample(words, rng.randint(1, 5)))) for k in range(n)]
    a, b = side(60), side(60)
    da, db = spark.createDataFrame(a, "product_id long, catalog_tokens array<string>"), spark.createDataFrame(b, "item_id long, listing_tokens array<string>")
    weight = lambda s: sum(2 if w in ("luva", "vinil", "caixa") else 1 for w in s)
    want = {(i, j) for i, x in a for j, y in b if weight(set(x) & set(y)) / weight(set(x) | set(y)) >= 0.5}
    got = {(r.product_id, r.item_id) for r in matching.candidates_by_tokens(da, db).collect()}
    assert want <= got and len(got) < 60 * 60


def test_two_phases(spark):
    products = matching.prepare(spark.createDataFrame([(1, "luva vinil p azul", "Luva Vinil P Azul"), (2, "secador", "Secador"), (3, "x y z w", "Frasco Vidro")], "product_id long, query string, name string"), "name", "catalog")
    results = matching.prepare(spark.createDataFrame([("LUVA vinil p", 1, "m1", "Luva Vinil P", 9), ("secador", 1, "m2", "Secador", 9), ("x y z", 1, "m3", "Outra Coisa", 9)], "query string, position int, item_id string, title string, sold_quantity long"), "title", "listing")
    got = matching.two_phase_match(products, results)
    assert {(r.product_id, r.phase) for r in got.collect()} == {(1, 2), (2, 1)}
    assert {r.product_id for r in matching.two_phase_match(products, results, retry_empty=False).collect()} == {2}


def model_price(prices):
    p, n = sorted(prices), len(prices)
    if n <= 3:
        return (p[n // 2] if n % 2 else (p[n // 2 - 1] + p[n // 2]) / 2), p[0], p[-1]
    low, high = max(1, round(n * 0.10)), max(1, round(n * 0.20))
    t = p[low : n - high] or p
    k = len(t)
    return (t[k // 2] if k % 2 else (t[k // 2 - 1] + t[k // 2]) / 2), t[int(k * 0.25)], t[min(k - 1, int(k * 0.75))]


def test_competitive_price(spark):
    rng = random.Random(1)
    groups = {n: [Decimal(rng.randrange(100, 2000)) for _ in range(n)] for n in (1, 2, 3, 4, 5, 10, 25, 45)}
    df = spark.createDataFrame([(k, p) for k, ps in groups.items() for p in ps], "product_id long, price decimal(12,2)").repartition(3)
    for r in market.competitive_price(df).collect():
        assert (r.avg_price, r.min_price, r.max_price) == model_price(groups[r.product_id]), r.product_id


LISTING = "product_id long, position int, item_id string, price decimal(12,2), sold_quantity long, seller_id long, condition string, listing_type string, category_id string, permalink string, free_shipping boolean, logistic_type string, ml_fee_pct decimal(5,2)"


def listing(product, position, item, price=10, sold=0, seller=0, category=""):
    return (product, position, item, Decimal(price), sold, seller, "", "", category, "", False, "", None)


def test_market(spark):
    df = spark.createDataFrame([listing(1, k, f"m{k}", 10 * k, 100 * k, k % 2) for k in range(1, 6)] + [listing(2, 1, "z", 5)], LISTING)
    got = {r.product_id: r for r in market.market_analysis(df).collect()}
    assert (got[1].total_sellers, got[1].avg_sold_quantity, got[1].total_sold_quantity, got[2].total_sellers, got[2].free_shipping_pct) == (1, 300, 1500, 0, 0)
    assert {r.item_id for r in market.sales_filter(df, 300).collect()} == {"m3", "m4", "m5", "z"}
    assert [r.rank_position for r in market.top_listings(df, 2).filter("product_id = 1").orderBy("rank_position").collect()] == [1, 2]
    assert market.pending(spark.createDataFrame([(1,), (9,)], "product_id long"), df).count() == 1
    batches = market.batch_id(spark.createDataFrame([("c", k) for k in range(85)], "catalog_id string, product_id long"), "product_id")
    assert {r.batch_id: r["count"] for r in batches.groupBy("batch_id").count().collect()} == {0: 40, 1: 40, 2: 5}


def test_enrichment(spark):
    df = spark.createDataFrame([listing(1, k, f"m{k}", 10) for k in range(1, 5)], LISTING)
    details = spark.createDataFrame([("m1", 50, "new", "gold", 7, True, "full", "c1", Decimal(99)), ("m4", 5, "new", "gold", 7, True, "full", "c1", Decimal(77))], feeds.DETAILS)
    fees = spark.createDataFrame([("c1", Decimal(0), Decimal(50), Decimal("12.50")), ("c1", Decimal(50), Decimal(999), Decimal("9.00"))], feeds.FEES)
    got = {r.item_id: r for r in market.enrich(df, details.drop("d_price"), fees, first=3).collect()}
    assert (got["m1"].sold_quantity, got["m1"].seller_id, got["m1"].ml_fee_pct, got["m4"].sold_quantity, got["m2"].ml_fee_pct) == (50, 7, Decimal("12.50"), 0, None)
    pages = {r.item_id: r for r in market.enrich_pages(df, details).collect()}  # m2 and m3 miss: m4 is not asked for
    assert (pages["m1"].price, pages["m1"].position, pages["m4"].sold_quantity, pages["m4"].price) == (Decimal(99), 1, 0, Decimal(10))


def fees(**more):
    return finance.FeeConfig(**{k: Decimal(str(v)) for k, v in more.items()})


def margin(spark, cost, price, **config):
    df = spark.createDataFrame([(Decimal(str(cost)), Decimal(str(price)))], "cost decimal(12,2), avg_market_price decimal(12,2)").withColumns(fees(**config).columns())
    return finance.margins(df).first()


def test_finance(spark):
    r = margin(spark, 50, 100)
    assert (r.ml_fee, r.gross_margin, r.gross_margin_pct, r.break_even_price, r.is_viable, r.net_margin) == (Decimal(15), Decimal(35), Decimal(35), Decimal("58.82"), True, None)
    assert margin(spark, 95, 100).gross_margin == Decimal(-10) and not margin(spark, 95, 100).is_viable
    assert margin(spark, 50, 100, ads_pct=5).net_margin == Decimal(30)
    assert margin(spark, 50, 100, packaging_cost_brl=2.5).net_margin == Decimal("32.50")
    r = margin(spark, 50, 0)
    assert (r.gross_margin, r.break_even_price, r.is_viable, r.gross_revenue) == (Decimal(-50), Decimal(50), False, 0)
    assert margin(spark, "0.01", 1000).price_safety_margin_pct == Decimal("999.99")
    assert margin(spark, 50, 100, ml_fee_pct=100).break_even_price == Decimal(100)
    assert margin(spark, 50, 100, tax_pct=70).min_price_for_target_margin is None


MARKET_IN = "product_id long, avg_price decimal(12,2), avg_ml_fee_pct decimal(5,2), free_shipping_pct decimal(5,2)"


def test_bad_products_are_isolated(spark):
    """what can't be worked out goes to the quarantine with its reason; the products beside it have their rows."""
    big = Decimal("9999999999.99")
    given = [  # cost, price, reason, fields
        ("50", "100", None, None), ("999999.00", "1.00", "overflow", ["net_margin_pct"]), (None, "100", "no_cost", ["cost"]), ("0", "100", "non_positive_cost", ["cost"]), ("-3", "100", "non_positive_cost", ["cost"]),
        ("50", None, "no_price", ["avg_price"]), ("99999999999.00", "100", "cost_overflow", ["cost"]), ("50", "0", None, None), (str(big), "0.01", "overflow", ["gross_margin_pct", "break_even_price", "net_margin", "net_margin_pct", "min_price_for_target_margin"]), ("0.01", str(big), None, None),
    ]
    number = lambda v: None if v is None else Decimal(v)
    products = spark.createDataFrame([(k, "c", "Luva", number(g[0])) for k, g in enumerate(given)], "product_id long, catalog_id string, raw_name string, cost decimal(20,2)")
    prices = spark.createDataFrame([(k, number(g[1]), None, Decimal(100)) for k, g in enumerate(given)], MARKET_IN)
    tried = finance.attempt(products, prices)
    good, bad = {r.product_id: r for r in finance.results(tried).collect()}, {r.product_id: r for r in finance.quarantine(tried).collect()}
    assert {k: (r.reason, r.fields) for k, r in bad.items()} == {k: (g[2], g[3]) for k, g in enumerate(given) if g[2]}
    assert set(good) == {k for k, g in enumerate(given) if not g[2]}
    assert (good[0].net_margin_pct, good[7].is_viable, good[9].price_safety_margin_pct) == (Decimal("12.00"), False, Decimal("999.99"))
    assert bad[1].cost == Decimal("999999.00") and "fault" not in finance.results(tried).columns
    assert finance.analyze(products, prices).count() == len(good)


def test_a_run_keeps_its_quarantine(spark):
    products = spark.createDataFrame([(1, "c", "Luva", None, Decimal(5)), (2, "c", "Luva", None, Decimal("999999.00")), (3, "c", "Luva", None, Decimal(6))], "product_id long, catalog_id string, raw_name string, normalized_name string, cost decimal(12,2)")
    df = spark.createDataFrame([listing(1, 1, "a", 100), listing(2, 1, "b", "0.99"), listing(3, 1, "c", 90)], LISTING)
    a = catalogs.analyze(products, df)
    assert sorted(r.product_id for r in a.scores.collect()) == [1, 3] and [(r.product_id, r.reason) for r in a.quarantine.collect()] == [(2, "overflow")]


SCORE_IN = "product_id long, catalog_id string, gross_margin_pct decimal(10,2), listings_above_threshold long, total_sellers long, avg_sold_quantity long, avg_match_confidence decimal(4,3), is_viable boolean"


def test_scores(spark):
    base = (Decimal(30), 10, 8, 5000, Decimal("0.85"), True)
    rows_ = [(1, "a", *base), (2, "a", Decimal(0), 50, 100, 0, None, False), (3, "a", *base), (4, "b", Decimal(40), 1, 3, 50000, Decimal("0.50"), True)]
    got = {r.product_id: r for r in scoring.rank(scoring.score(spark.createDataFrame(rows_, SCORE_IN).repartition(3))).collect()}
    assert (got[1].demand_score, got[1].margin_score, got[1].competition_score, got[1].confidence_score, got[1].final_score) == (55, 80, 90, 85, Decimal("73.25"))
    assert (got[2].demand_score, got[2].final_score, got[2].recommendation, got[2].confidence_score) == (100, Decimal("45.75"), "ARRISCADA", 100)
    assert [got[k].rank_position for k in (1, 3, 2, 4)] == [1, 2, 3, 1]
    assert got[4].explanation == "Alta demanda comprovada, margem excelente, baixa concorrência, dados de matching com baixa confiança — verificar manualmente."
    assert got[2].explanation.startswith("Produto inviável")
    edges = spark.createDataFrame([(Decimal(x),) for x in ("75", "74.99", "55", "54.99", "35", "34.99")], "final_score decimal(5,2)")
    assert [r.c for r in edges.orderBy(F.desc("final_score")).select(scoring.classify().alias("c")).collect()] == ["EXCELENTE", "BOA", "BOA", "ARRISCADA", "ARRISCADA", "EVITAR"]


SHEET = [["Catálogo 2024"], ["Distribuidora X"], [None], ["Produto", "Preço de Custo", "Código", "Grupo", "Qtd"], ["Caixa P", "5,00", "CX-P", "Embalagens", "1"], ["Caixa M", "R$ 7,50", "CX-M", None, "1"],
         ["Subtotal Embalagens", "12,50"], ["Luva Vinil", "10,00", "LV", "EPI", "2"], ["Luva Nitrilo", "abc", "LN", None, "2"], ["12345", "3,00"], ["Luva Latex", "9,90", "lv ", None, "2"], [None, " "], ["Total Geral", "99"]]


def raw_rows(spark, sheet=SHEET, extra=()):
    data = [("c1", 1, "Plan1", k, cells) for k, cells in enumerate([*sheet, *extra])] + [("c1", 0, "Config", k, ["a", "b"]) for k in range(50)]
    return spark.createDataFrame(data, feeds.RAW_ROWS).repartition(3)


def test_parse_catalog(spark):
    products, quality = catalogs.parse(raw_rows(spark))
    got = sorted((r.raw_name, float(r.cost), r.sku, r.category, r.is_dup_sku) for r in products.collect())
    assert got == [("Caixa M", 7.5, "CX-M", "Embalagens", False), ("Caixa P", 5.0, "CX-P", "Embalagens", False), ("Luva Latex", 9.9, "lv", "EPI", True), ("Luva Vinil", 10.0, "LV", "EPI", False)]
    q = quality.first()
    assert (q.total_rows_scanned, q.valid_products, q.skipped_empty, q.skipped_subtotal, q.skipped_invalid_cost, q.skipped_invalid_name, q.cost_parse_errors, q.duplicate_skus) == (9, 4, 1, 2, 1, 1, 1, 1)
    assert (q.success_rate, q.confidence) == (0.5, "PARTIAL")


def test_blank_run(spark):
    products, quality = catalogs.parse(raw_rows(spark, extra=[[None]] * 10 + [["Escondido", "1,00"]]))
    assert "Escondido" not in {r.raw_name for r in products.collect()} and quality.first().total_rows_scanned == 9


def test_headers(spark):
    names = ["Produto", "PREÇO DE CUSTO", "Código", "Categoria", "Fornecedor", "Estoque", None, "linha de produto", "Nome do Produto"]
    df = spark.createDataFrame([("c", k, h) for k, h in enumerate(names)], "catalog_id string, col_idx int, header string")
    got = {r.field: r.col_idx for r in headers.map_headers(df).collect()}
    assert got == {"product_name": 0, "cost": 1, "sku": 2, "category": 3, "supplier": 4}
    assert headers.mapping_status(headers.map_headers(df)).first().has_required
    cols = spark.createDataFrame([("c", 0, "Marca"), ("c", 1, "Código Modelo"), ("c", 2, "Query ML")], "catalog_id string, col_idx int, header string")
    assert tuple(headers.find_precision_cols(cols).first()) == ("c", 2, 1, 0)


def test_feeds(spark):
    api = '[{"id":"m1","title":" A ","price":10.005,"seller":{"id":4}},{"id":"","title":"x","price":1},{"id":"m2","title":"B","price":0}]'
    got = feeds.parse_api_listings(spark.createDataFrame([("q", api)], "query string, json string")).collect()
    assert [(r.item_id, r.title, r.price, r.sold_quantity, r.seller_id, r.position) for r in got] == [("m1", "A", Decimal("10.00"), 0, 4, 1)]
    actor = '[{"eTituloProduto":"A","novoPreco":""},{"eTituloProduto":"B","novoPreco":"1.234,50","zProdutoLink":"u/MLB-12"}]'
    got = feeds.parse_actor_listings(spark.createDataFrame([("q", actor)], "query string, json string")).collect()
    assert [(r.item_id, r.price, r.position) for r in got] == [("MLB12", Decimal("1234.50"), 2)]
    card = '<li class="ui-search-layout__item"><a class="poly-component__title" href="https://x/MLB-99-a">Luva</a><span class="andes-money-amount__fraction">1.234</span><span class="poly-component__sold-title">+5 mil</span></li>'
    got = markup.extract_listing_cards(spark.createDataFrame([("q", "<ul>" + card + '<li class="ui-search-layout__item">none</li></ul>')], "query string, html string")).collect()
    assert [(r.item_id, r.title, int(r.price), r.sold_quantity) for r in got] == [("MLB99", "Luva", 1234, 5000)]
    products = spark.createDataFrame([("c", k, "x" if k == 1 else None) for k in range(4)], "catalog_id string, product_id long, normalized_name string")
    names = feeds.apply_name_batches(products, spark.createDataFrame([("c", 0, '["a"," ",null]')], "catalog_id string, batch long, json string"))
    assert {r.product_id: r.normalized_name for r in names.collect()} == {0: "a", 1: "x", 2: None, 3: None}


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nome,custo\nx,1\n\n\"y\nz\",\"1,5\"\n,2\nNA\n")
    (tmp_path / "b.csv").write_bytes("nome;preço\ny;2\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("\ufeffnome|nome|\nó|2|3\n".encode())
    (tmp_path / "d.csv").write_text("nome,custo\nx,1,2\n")  # more cells than columns: no separator fits
    (tmp_path / "e.csv").write_text("\n")
    (tmp_path / "f.csv").write_text("")  # Spark passes files of no length over
    rows_ = csv_files.read_csv_files(spark, f"file://{tmp_path}/*.csv")
    got = {(r.catalog_id.rsplit("/", 1)[1][0], r.row_idx): r for r in rows_.collect()}
    assert {k: r.cells for k, r in got.items()} == {("a", 0): ["nome", "custo"], ("a", 1): ["x", "1"], ("a", 2): ["y\nz", "1,5"], ("a", 3): [None, "2"], ("a", 4): [None, None], ("b", 0): ["nome", "preço"], ("b", 1): ["y", "2"], ("c", 0): ["nome", "nome.1", "Unnamed: 2"], ("c", 1): ["ó", "2", "3"], ("d", None): None, ("e", None): None}
    assert {r.catalog_id[-5]: (r.sep, r.encoding, r.status, r.n_rows) for r in csv_files.csv_dialects(spark, f"file://{tmp_path}/*.csv").collect()} == {"a": (",", "utf-8", "OK", 4), "b": (";", "ISO-8859-1", "OK", 1), "c": ("|", "utf-8", "OK", 1), "d": (None, "utf-8", "FAILED", 0), "e": (None, "utf-8", "FAILED", 0)}
    assert sorted(r.record["nome"] or "" for r in csv_files.csv_records(rows_).collect()) == ["", "", "x", "y", "y\nz", "ó"]
    plan = rows_._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_csv_catalogs(spark, tmp_path):
    """Names of precision, texts of none, files without the columns that are needed."""
    (tmp_path / "a.csv").write_text("Produto,Custo,Query ML,Código Modelo,Marca,SKU\n Luva ,\"1,50\",luva nitrilo,M1,Exbom,1\nCaixa,2,,M2,Exbom,nan\nCabo,3,,M3,,2\nFone,4,none,,Exbom,3\nnone,5,,,,\nPano,x,,,,\n")
    (tmp_path / "b.csv").write_text("foo,bar\n1,2\n")
    (tmp_path / "c.csv").write_text("one\n")
    (tmp_path / "d.csv").write_text("Produto;Custo;Modelo\nLuva;1;M1\n")  # a model without a brand's column says nothing
    products, quality = catalogs.parse_csv(csv_files.read_csv_files(spark, f"file://{tmp_path}/*.csv"))
    got = {(r.catalog_id[-5], r.raw_name): (float(r.cost), r.normalized_name, r.sku, r.supplier) for r in products.collect()}
    assert got == {("a", "Luva"): (1.5, "luva nitrilo", "1", "Exbom"), ("a", "Caixa"): (2, "Exbom M2", None, "Exbom"), ("a", "Cabo"): (3, "M3", "2", None), ("a", "Fone"): (4, None, "3", "Exbom"), ("d", "Luva"): (1, None, None, None)}
    assert {r.catalog_id[-5]: (r.total_rows_scanned, r.valid_products, r.skipped_invalid_name, r.skipped_invalid_cost, r.confidence) for r in quality.collect()} == {"a": (6, 4, 1, 1, "PARTIAL"), "b": (0, 0, 0, 0, "FAILED"), "c": (0, 0, 0, 0, "FAILED"), "d": (1, 1, 0, 0, "RELIABLE")}


def test_page_tables(spark):
    good, weak = ["Produto", "Custo"], ["Item", "Código Modelo Marca"]
    tables = {0: [good, ["x", "1"]], 1: [["Lista", None], good, ["x", "1"]], 2: [good, ["Produto Nome", "SKU Código"], ["x", "1"]], 3: [weak, ["x", "1"]], 4: [good]}
    df = spark.createDataFrame([("c", t, k, cells) for t, rs in tables.items() for k, cells in enumerate(rs)], "catalog_id string, table_idx int, row_idx int, cells array<string>").repartition(3)
    got = {r.table_idx: (r.header_row, r.product_name, r.cost) for r in headers.page_tables(df).collect()}
    assert got == {0: (0, 0, 1), 1: (1, 0, 1), 2: (0, 0, 1)}


def test_sinks_and_reports(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "product_id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "product_id long, v string")
    assert sorted(map(tuple, sinks.upsert(old, new).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.replace_children(old, new.filter("product_id = 2")).collect())) == [(1, "a"), (2, "c")]
    assert one(spark, sinks.migrate_recommendation("x"), "ALTA", "BOA") == ["EXCELENTE", "BOA"]
    counts = reports.recommendation_counts(spark.createDataFrame([("c", "BOA"), ("c", "BOA")], "catalog_id string, recommendation string"))
    assert {r.recommendation: r.products for r in counts.collect()} == {"EXCELENTE": 0, "BOA": 2, "ARRISCADA": 0, "EVITAR": 0}
    done, minutes = reports.stage_progress()
    got = spark.createDataFrame([("RESEARCHING", 61), ("READY", 61)], "status string, total_products int").select(done.alias("d"), minutes.alias("m")).collect()
    assert [(r.d, r.m) for r in got] == [(30, 3), (100, None)]


def streamed(spark, folder, batches):
    for b in batches:
        spark.createDataFrame(b, LISTING).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    streaming.stream_market(spark, f"{folder}/in", LISTING, f"{folder}/out", f"{folder}/cp", files=1, buckets=4).awaitTermination()


def market_key(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_segments_are_binary_digits():
    assert [streaming.segments(n) for n in (0, 1, 2, 3, 6, 8)] == [[], [(0, 0)], [(0, 1)], [(0, 1), (2, 2)], [(0, 3), (4, 5)], [(0, 7)]]
    for n in range(200):
        before, after = streaming.segments(n), streaming.segments(n + 1)
        assert set(after[:-1]) <= set(before) and after[-1][1] == n and len(after) <= 8
    # each batch is written once for every digit at most
    assert sum(s[1] - s[0] + 1 for s in (streaming.segments(n + 1)[-1] for n in range(256))) <= 256 * 9


def test_streamed_market_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    batches = [[listing(rng.randrange(7) + 3 * b, k, f"m{b}{k}", rng.randrange(5, 90), seller=rng.randrange(4)) for k in range(20)] for b in range(3)]  # products come in several batches
    streamed(spark, tmp_path, batches[:2])
    assert market_key(streaming.read_market(spark, f"{tmp_path}/out")) == market_key(market.market_analysis(spark.createDataFrame(sum(batches[:2], []), LISTING)))
    streamed(spark, tmp_path, batches[2:])  # resumes
    want = market_key(market.market_analysis(spark.createDataFrame(sum(batches, []), LISTING)))
    state = streaming.State(spark, f"{tmp_path}/out", 4)
    assert market_key(streaming.read_market(spark, f"{tmp_path}/out")) == want and state.there() == [(0, 1), (2, 2)]
    # a batch that runs again writes the same, a run again finds nothing new
    streaming.add_batch(state, spark.createDataFrame(batches[2], LISTING), 2)
    streamed(spark, tmp_path, [])
    assert market_key(streaming.read_market(spark, f"{tmp_path}/out")) == want and state.there() == [(0, 1), (2, 2)]
    # a batch whose predecessor is missing is an error
    (tmp_path / "out" / "segment=2-2").rename(tmp_path / "gone")
    with pytest.raises(Exception, match="lacks batches"):
        streaming.add_batch(state, spark.createDataFrame(batches[0], LISTING), 3)


def test_a_batch_reads_touched_state_only(spark, tmp_path):
    """Buckets that a batch doesn't touch may even be unreadable."""
    state = streaming.State(spark, f"{tmp_path}/out", 8)
    rows_ = [[listing(p, 1, f"m{p}", 10 + p) for p in range(40)], [listing(p, 2, f"n{p}", 20 + p) for p in range(40)]]
    for k, r in enumerate(rows_):
        streaming.add_batch(state, spark.createDataFrame(r, LISTING), k)
    bucket = state.bucketed(spark.createDataFrame([(7,)], "product_id long")).first().bucket
    spoilt = [f for f in tmp_path.rglob("segment=0-1/*/bucket=*/*.parquet") if f.parent.name != f"bucket={bucket}"]
    for f in spoilt:
        f.write_bytes(b"no parquet")
    streaming.add_batch(state, spark.createDataFrame([listing(7, 3, "x", 1000)], LISTING), 2)
    got = state.read("market", [(2, 2)], spark.read.parquet(state.folder((2, 2), "market")).schema).collect()
    assert len(spoilt) > 9 and [(r.product_id, r.total_listings_found, r.max_price) for r in got] == [(7, 3, Decimal(1000))]


def test_heavy_products_are_selected(spark):
    """Products over the limit give the same rows by selection; their listings are never dealt by product."""
    rng = random.Random(3)
    sizes = {1: 400, 2: 3, 3: 55, 4: 1, 5: 121, 6: 60, 7: 20}
    data = [listing(p, k, f"m{p}-{k}", rng.choice([Decimal(rng.randrange(1, 5000)) / 100, Decimal(-3), Decimal("9999999999.99"), 7]), rng.randrange(50), rng.randrange(9)) for p, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(data, LISTING).repartition(5)
    for f in (market.market_analysis, market.competitive_price):
        assert market_key(f(df, 50)) == market_key(f(df))
    plain = {r.product_id: r for r in market.competitive_price(df, 50).collect()}
    for p in sizes:
        a, low, high = model_price([Decimal(r[3]) for r in data if r[0] == p])
        assert (plain[p].avg_price, plain[p].min_price, plain[p].max_price) == (round(a, 2), low, high)


def test_market_crosses_the_network_once(spark, sf):
    from resalio.sources import driver

    plan = market.market_analysis(driver.listings(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_places_of_large_groups(spark):
    rng = random.Random(6)
    groups = {g: [rng.choice([rng.randrange(-(2**39), 2**39), rng.randrange(5), 2**39]) for _ in range(n)] for g, n in ((1, 1), (2, 50), (3, 700))}
    values = spark.createDataFrame([(g, v, 1 + v % 3) for g, vs in groups.items() for v in vs] + [(3, None, 1)], "product_id long, cents long, times long").repartition(4)
    wanted = spark.createDataFrame([(g, f"at{k}", k) for g, vs in groups.items() for k in {0, len(vs) // 2, len(vs) - 1, len(vs)}], "product_id long, name string, place long")
    got = {(r.product_id, r.name): r.cents for r in selection.at_places(values, wanted).collect()}
    assert got == {(g, f"at{k}"): sorted(vs)[k] for g, vs in groups.items() for k in {0, len(vs) // 2, len(vs) - 1}}
    often = {g: sorted(v for v in vs for _ in range(1 + v % 3)) for g, vs in groups.items()}
    got = {(r.product_id, r.name): r.cents for r in selection.at_places(values, wanted, times="times").collect()}
    assert all(got[g, f"at{k}"] == often[g][k] for g, vs in groups.items() for k in {0, len(vs) // 2, len(vs) - 1})


def test_catalogs_without_columns_fail(spark):
    sheets = {"good": SHEET, "no cost": [["Produto", "SKU"], ["Luva", "1"]], "unknown": [["foo", "bar"], ["Luva", "1,00"]], "blank": [[None], [" "]]}
    data = [(c, 0, "Plan1", k, cells) for c, sheet in sheets.items() for k, cells in enumerate(sheet)]
    products, quality = catalogs.parse(spark.createDataFrame(data, feeds.RAW_ROWS).repartition(3))
    assert {r.catalog_id: (r.confidence, r.total_rows_scanned) for r in quality.collect()} == {"good": ("PARTIAL", 9), "no cost": ("FAILED", 0), "unknown": ("FAILED", 0), "blank": ("FAILED", 0)}
    assert {r.catalog_id for r in products.select("catalog_id").distinct().collect()} == {"good"}


def test_market_reads_listings_once(spark, sf):
    from resalio.sources import driver

    plan = market.market_analysis(driver.listings(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_numbers_of_large_groups(spark):
    rng = random.Random(4)
    data = [("big" if rng.random() < 0.9 else "small", rng.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(data, "catalog_id string, x int, k int").repartition(5)
    got = ordering.numbered(df, ["catalog_id"], [F.desc("x"), F.col("k")], "n").collect()
    for c in ("big", "small"):
        own = sorted((r for r in got if r.catalog_id == c), key=lambda r: (-r.x, r.k))
        assert [r.n for r in own] == list(range(1, len(own) + 1))
    assert ordering.numbered(df.limit(0), ["catalog_id"], [F.col("k")], "n").count() == 0


def test_rows(spark):
    df = spark.createDataFrame([("c", k, n, c) for k, (n, c) in enumerate([("A", None), ("a", Decimal(3)), ("B", Decimal(2))])], "catalog_id string, row_idx int, raw_name string, cost decimal(12,2)")
    assert [r.raw_name for r in rows.dedup_names(df).collect()] == ["B"]
    t = spark.createDataFrame([("c", 0, "x"), ("c", 1, None), ("c", 2, None)], "catalog_id string, table_idx int, skip_reason string")
    assert [r.table_idx for r in rows.first_usable_table(t).collect()] == [1]


def test_values_are_carried_over_ranges(spark):
    rng = random.Random(5)
    data = [("big" if rng.random() < 0.9 else f"s{rng.randrange(4)}", k, rng.randrange(100) if rng.random() < 0.02 else None) for k in range(3000)]
    df = spark.createDataFrame(data, "g string, k int, v int").repartition(6)
    got = {(r.g, r.k): (r.last, r.no) for r in ordering.carried(df, ["g"], ["k"], {"last": F.col("v")}, number="no").collect()}
    last, no = {}, {}
    for g, k, v in sorted(data, key=lambda r: (r[0], r[1])):
        last[g] = v if v is not None else last.get(g)
        no[g] = no.get(g, 0) + 1
        assert got[g, k] == (last[g], no[g]), (g, k)
    assert ordering.carried(df.limit(0), ["g"], ["k"], {"last": F.col("v")}).count() == 0


def test_large_sheets_parse_alike(spark):
    """R3, R8, R9 over ranges of a sheet give what windows give."""
    rng = random.Random(8)
    line = lambda k: rng.choice([[f"Luva {rng.randrange(40)}x", "1,00", f"s{rng.randrange(30)}", f"c{k}" if rng.random() < 0.1 else None, "f"], [None, " "], ["Luva ruim", "abc", "x", None, None]])
    sheets = {"a": [line(k) for k in range(400)], "b": [line(k) for k in range(60)] + [[None]] * 10 + [line(k) for k in range(50)], "c": [[None]] * 9 + [line(k) for k in range(90)] + [[None]] * 10 + [line(1)]}
    head = ["Produto", "Custo", "SKU", "Categoria", "Fornecedor"]
    data = [(c, 0, "Plan1", k, cells) for c, rs in sheets.items() for k, cells in enumerate([head, *rs])]
    df = spark.createDataFrame(data, feeds.RAW_ROWS).repartition(3)
    key = lambda t: sorted((tuple(r) for r in t.collect()), key=str)
    assert rows.large_sheets(df, 50).count() == 3 and rows.large_sheets(df) is None
    for whole, parted in zip(catalogs.parse(df), catalogs.parse(df, most=70)):
        assert key(whole) == key(parted) and len(key(whole)) >= 3


def test_fees_of_many_bands(spark):
    rng = random.Random(9)
    bands = [(f"c{c}", Decimal(10 * k), Decimal(10 * k + 8), Decimal(k % 20)) for c in range(3) for k in range(300)]
    fees = spark.createDataFrame(bands, feeds.FEES).repartition(3)
    data = [listing(1, k, f"m{k}", rng.randrange(0, 3100), category=rng.choice(["c0", "c0", "c0", "c1", "c9", ""])) for k in range(600)]
    df = spark.createDataFrame(data, LISTING).withColumns({"__head": F.col("position") % 5 > 0, "ml_fee_pct": F.lit(99).cast("decimal(5,2)")})
    got = {r.item_id: r.ml_fee_pct for r in market.lookup_fee(df, fees).collect()}
    for p, k, item, price, *_, category, _, _, _, _ in ((*r[:4], *r[4:]) for r in data):
        asked = k % 5 > 0 and category and price > 0
        want = next((f for c, a, b, f in bands if c == category and a <= price < b), None) if asked else Decimal(99)
        assert got[item] == want, (item, price, category)
    assert len(got) == len(data) and market.lookup_fee(df, fees).columns == df.columns


def test_enrichment_keeps_one_row_a_listing(spark):
    """Positions that are shared and details that come twice multiply nothing."""
    df = spark.createDataFrame([listing(1, 1, "a", 10), listing(1, 1, "b", 10), listing(1, 2, "c", 10)], LISTING)
    detail = ("a", 5, "new", "gold", 7, True, "full", "c1", Decimal(1))
    details = spark.createDataFrame([detail, detail, ("a", 9, *detail[2:]), ("b", 3, *detail[2:])], feeds.DETAILS).drop("d_price")
    got = sorted((r.item_id, r.sold_quantity) for r in market.enrich(df, details, first=2).collect())
    assert got == [("a", 9), ("b", 3), ("c", 0)]


def test_a_run_goes_on_after_its_last_stage(spark, tmp_path, monkeypatch):
    """A run that stops after market finishes without its listings; steps on the way are gone."""
    products = spark.createDataFrame([(k, "c", "Luva", None, Decimal(5)) for k in range(4)], "product_id long, catalog_id string, raw_name string, normalized_name string, cost decimal(12,2)")
    spark.createDataFrame([listing(k, 1, f"m{k}", 50 + k) for k in range(4)], LISTING).write.parquet(f"{tmp_path}/listings")
    listings = spark.read.parquet(f"{tmp_path}/listings")
    run = shared.Run(spark, f"file://{tmp_path}/run")
    with monkeypatch.context() as m:
        m.setattr(catalogs.fin, "attempt", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            catalogs.analyze(products, listings, run=run)
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["market"]
    (tmp_path / "listings").rename(tmp_path / "gone")
    a = catalogs.analyze(products, listings, run=shared.Run(spark, f"file://{tmp_path}/run"))
    assert a.scores.count() == 4 and sorted(p.name for p in (tmp_path / "run").iterdir()) == ["finance", "market", "scores"]
    assert shared.written(spark, f"{run.folder}/scores") and not shared.written(spark, f"{run.folder}/other")
    run.clear()
    assert not (tmp_path / "run").exists()


def test_steps_are_cleared(spark):
    kept = shared.materialize(spark.range(3), "kept")
    inner = []

    def make():
        inner.append(shared.materialize(kept, "inner"))
        return inner[0].withColumn("x", F.col("id") + 1)

    out = shared.settled(spark, "out", make)
    assert out.count() == 3 and kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        inner[0].collect()


def test_markup():
    page = markup.Page("<p class=\"a b\">x <b>y<br>z</p> t &amp; u<style>p{}</style></i><div data-x='1>2'>w")
    assert [e.tag for e in page.elements] == ["p", "b", "br", "style", "div"] and page.texts == ["x", "y", "z", "t & u", "w"]
    p, b, _, _, div = page.elements
    assert page.text(p) == "xyz" and page.text(b) == "yz" and page.text(div) == "w" and page.within(p, markup.has("none"), lambda e: e.tag == "b") is b
    assert markup.cards(None) == markup.cards("") == markup.cards("<<<>&&") == []
    wide = markup.cards('<div class="x andes-card ui-search-result"><a class="ui-search-link" href="MLB-3">t</a><h2 class="ui-search-item__title"> </h2></div>')
    assert wide == [{"permalink": "MLB-3", "title": "", "price": None, "sold": None}]
    assert markup.outline("<title>a &lt; b</title><a href=x>1</a><a name=y>2</a>") == {"title": "a < b", "links": 1}
