"""Files of any number: written and listed in tasks."""


from resalio.queries import sheets
from resalio.sources import csv_files, sinks
from resalio.sources.shared import new_folder


def test_files_are_written_and_read_in_tasks(spark):
    texts = spark.createDataFrame([("0", "a#1.csv", "nome,custo\nx,1\n"), ("0", "b.csv", "nome;preço\ny;2\n"), ("1", "c.csv", "nome\n"), ("1", "d.csv", ""), ("1", "_e.csv", "nome,custo\nx,1\n")], "folder string, name string, value string")
    folders = sinks.write_files(texts, new_folder(spark, "files"))
    assert folders.count() == 2
    got = {(r.catalog_id.rsplit("/", 1)[1], r.row_idx): (r.status, r.cells) for r in csv_files.read_csv_folders(folders).collect()}
    assert got == {("a#1.csv", 0): ("OK", ["nome", "custo"]), ("a#1.csv", 1): ("OK", ["x", "1"]), ("b.csv", 0): ("OK", ["nome", "preço"]), ("b.csv", 1): ("OK", ["y", "2"]), ("c.csv", None): ("FAILED", None)}


def test_the_driver_lists_no_files(spark, sf):
    """No plan over the many files names them; as Spark's reader does, whose list the driver holds."""
    rows = sheets.many_csv(spark, sf)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert ".txt" not in plan and "binaryFile" not in plan
    files = {f.rsplit("/", 1)[1] for f in rows.inputFiles()}
    assert files and all(f.endswith(".parquet") for f in files)  # the folders' names alone
    assert rows.select("catalog_id").distinct().count() == len({k // 10 for k in (r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect())})
