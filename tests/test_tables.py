"""Keyed tables and the layout of reports: what is changed, what is read, what stays."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from resalio.sources.tables import KeyedTable, save_laid_out


def files(folder):
    """Name, size and time of each bucket's files."""
    return {b.name: sorted((f.name, f.stat().st_size, f.stat().st_mtime_ns) for f in b.glob("*.parquet")) for b in folder.glob("bucket=*")}


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_upsert_keeps_the_files_of_other_buckets(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", buckets=16).create(spark.range(200).select(F.col("id").alias("product_id"), F.lit("old").alias("v")))
    before = files(tmp_path / "t")
    new = spark.createDataFrame([(3, "new"), (1000, "new")], "product_id long, v string")
    table.upsert(new)
    table.upsert(new)  # twice is once
    after = files(tmp_path / "t")
    touched = {f"bucket={b}" for b in table.touched(new)}
    assert {b for b in before if before[b] != after[b]} == touched and len(before) > 12
    assert rows(table) == sorted([(k, "new" if k == 3 else "old") for k in range(200)] + [(1000, "new")], key=str)


def test_children_and_deletes(spark, tmp_path):
    rng = random.Random(1)
    given = [(rng.randrange(30), k) for k in range(300)] + [(None, 1)]
    schema = "product_id long, child long"
    table = KeyedTable(spark, f"{tmp_path}/t", buckets=8).create(spark.createDataFrame(given, schema))
    new = [(4, 9000), (4, 9001), (99, 9002)]
    table.replace_children(spark.createDataFrame(new, schema))
    want = sorted([r for r in given if r[0] not in (4, 99)] + new, key=str)
    assert rows(table) == want
    before = files(tmp_path / "t")
    gone = spark.createDataFrame([(5, 0), (5, 0), (6, 0)], schema)
    table.delete(gone)
    assert rows(table) == [r for r in want if r[0] not in (5, 6)]
    after = files(tmp_path / "t")
    assert {b for b in before if before[b] != after.get(b)} == {f"bucket={b}" for b in table.touched(gone)}
    table.delete(spark.createDataFrame(want, schema).filter("product_id IS NOT NULL"))
    assert rows(table) == [(None, 1)]
    for change in (table.upsert, table.replace_children, table.delete):
        change(spark.createDataFrame([], schema))
    assert rows(table) == [(None, 1)]


def test_reports_prune_and_join_without_shuffles(spark):
    base = spark.range(500).select(F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("catalog_id"), F.col("id").alias("product_id"), (F.col("id") * 7 % 101).alias("final_score"))
    a, b = save_laid_out(base, "laid_scores", 4), save_laid_out(base.withColumn("price", F.lit(1)), "laid_market", 4)
    one = lambda t: t.filter("catalog_id = 'c3'")
    joined = one(a).hint("merge").join(one(b).select("product_id", "price"), "product_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("PartitionFilters: [isnotnull(catalog_id") == 2 and joined.count() == 100
    page = a.filter("catalog_id = 'c1'").orderBy("product_id").limit(5)
    assert [r.product_id for r in page.collect()] == [1, 6, 11, 16, 21] and "PartitionFilters: [isnotnull(catalog_id" in page._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE laid_scores")
    spark.sql("DROP TABLE laid_market")


def test_a_catalogs_report_reads_its_folder(spark, sf):
    from resalio import registry

    plan = registry.queries()["written_catalog"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(catalog_id" in plan and "Exchange" not in plan
