"""A corpus pipeline: toxicity, line dedup, near-dedup, personal data, packing, each on what the last one kept."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resalio.llm.common import materialize, table, unused
from resalio.llm.jaccard import near_copies
from resalio.llm.lines import drop_recurring
from resalio.llm.packing import pieces
from resalio.llm.pii import detect
from resalio.llm.toxicity import keep_clean
from resalio.sources.shared import settled


def with_text(docs: DataFrame, changed: DataFrame, field: str) -> DataFrame:
    """The columns of docs, from changed, with the text that its last column holds, and its length."""
    text = F.col(f"`{changed.columns[-1]}`.{field}")
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return changed.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    A null text is judged as an empty one, which has no matches. Rows that share a doc_id are judged one by one, rows
    with a null doc_id too. An empty table stays one. Labels that aren't 0 or 1 are left out; without labels of both
    kinds nothing is known to be toxic beyond their share, and an empty lexicon rejects nothing.
    """
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; all documents stay.

    Null texts stay null. Rows with a null doc_id keep all lines. Rows that share a doc_id or a text count as one
    document: of a line that recurs, all rows with the text that has it first keep it. An empty table stays one.
    """
    return with_text(docs, drop_recurring(docs), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, a Jaccard similarity of 0.8 or more) one row stays: of those with the least doc_id the first in the table.

    A null doc_id comes after all others, so a group of null ids alone keeps a row too. Rows that share a doc_id
    are judged by their texts like any others: of one group one row stays, in different groups each does. Null and
    empty texts, and texts of white space, are one group. An empty table stays one.
    """
    row = unused(docs, "row_of_docs")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = near_copies(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    known = materialize(classes.join(rows.select(row, F.col("doc_id").alias("doc")), row), "row-classes")
    # written before it is joined: then Spark can split hot keys of the join
    best = materialize(known.groupBy("component_id").agg(F.min(F.struct(F.col("doc").isNull(), "doc", row)).getField(row).alias("best")), "best")
    gone = known.join(best, "component_id").filter(F.col(row) != F.col("best")).select(row)
    return rows.join(gone, row, "left_anti").drop(row)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; all documents stay.

    Null texts stay null, empty ones empty. Every row is judged by itself, so repeated rows stay alike and a null
    doc_id doesn't matter. An empty table stays one.
    """
    return with_text(docs, detect(docs), "redacted")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences that the documents are packed into.

    A null or empty text is its end id alone. Every row is packed, repeated ones too; a null doc_id stays null. An
    empty table gives no rows.
    """
    return pieces(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: SQL can't express these stages; tests hold each against plain Python, text by text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again, and the steps on its way are cleared."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, name, partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
