"""How joins of the queries are planned: tables that grow with the input are never broadcast, however small Spark takes them for."""

from pyspark.sql import functions as F

from resalio.functions import vocabulary as V
from resalio.operators import headers as H
from resalio.operators import rows as R
from resalio.queries import pairing, sheets


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_prepared_names_are_not_broadcast(spark, sf):
    p = plan(pairing.match_marks(spark, sf))
    assert "SortMergeJoin [product_id" in p and "SortMergeJoin [item_id" in p and "BroadcastHashJoin [product_id" not in p and "BroadcastHashJoin [item_id" not in p


def test_tables_of_pages_are_not_broadcast(spark, sf):
    p = plan(sheets.page_tables(spark, sf))
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


def test_any_score_is_the_best_of_scores(spark):
    """All words at once tell what each word's score tells."""
    words = H.VOCABULARY
    norms = {*words, *(w[:5] for w in words), *(w[1:] for w in words), *(f"x{w} y" for w in words), *(w[:3] for w in words), "foo", "12,5", "a.b", "luva"}
    df = spark.createDataFrame([(n,) for n in sorted(norms) if n], "norm string")
    for some in (words, *V.COLUMN_NAMES.values()):
        best = F.greatest(*[H.word_score(F.col("norm"), F.lit(w)) for w in dict.fromkeys(some)], F.lit(0.0))
        assert df.filter(H.any_score(F.col("norm"), list(some)) != (best > 0)).count() == 0


def test_columns_of_many_files_are_not_broadcast(spark):
    rows = spark.createDataFrame([("a", 0, ["Produto", "Custo"]), ("a", 1, ["Luva", "1,50"])], "catalog_id string, row_idx int, cells array<string>")
    fields = R.csv_fields(rows)
    assert "BroadcastHashJoin" not in plan(fields)
    assert [(r.raw_name, r.cost_text) for r in fields.collect()] == [("Luva", "1,50")]


def test_first_matches_are_scored_once(spark, sf):
    """What comes of the first try is read, not scored again; where all products have matches nothing else is."""
    assert "first-matches" in plan(pairing.two_phase(spark, sf))
    named = spark.createDataFrame([(1, "luva azul", "luva azul")], "product_id long, name string, query string")
    found = spark.createDataFrame([("luva azul", 5, "luva azul", 9)], "query string, item_id long, title string, sold_quantity long")
    all_matched = pairing.M.two_phase_match(pairing.M.prepare(named, "name", "catalog"), pairing.M.prepare(found, "title", "listing"))
    assert "array_intersect" not in plan(all_matched) and [(r.product_id, r.item_id, r.phase) for r in all_matched.collect()] == [(1, 5, 1)]
