"""Incremental runs (I3): listings that arrive as files update market tables by key.

What market rows need of listings can be merged: how often each product has each price, its sellers, its sums. A batch
of files adds its own to this state and works out the rows of the products in it, from their state alone.

The state lies in segments, each of the batches from a first to a last one, by bucket of products. After so many batches
the segments are those of the number's binary digits: a batch writes one new segment, its own listings merged with the
segments that it replaces, so that a listing is rewritten as often as the number of batches has digits, and a product's
state lies in as many places. Segments don't change once written, and what a batch reads and writes depends on its
number alone: a batch that runs again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import market as mkt
from ..sources.shared import delete, materialize, scratch, written

#: Parts of the products; a batch reads the parts of the products in it.
BUCKETS = 64
Segment = tuple[int, int]


def segments(batches: int) -> list[Segment]:
    """(first, last batch) of the segments after so many batches, oldest first."""
    out, at = [], 0
    for k in range(batches.bit_length() - 1, -1, -1):
        if batches >> k & 1:
            out.append((at, at + 2**k - 1))
            at += 2**k
    return out


class State:
    """The state under a folder, for listings of one schema."""

    def __init__(self, spark: SparkSession, target: str, buckets: int = BUCKETS) -> None:
        self.spark, self.target, self.buckets = spark, target.rstrip("/"), buckets

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("product_id"), F.lit(self.buckets)).cast("int"))

    def folder(self, segment: Segment, table: str) -> str:
        return f"{self.target}/segment={segment[0]}-{segment[1]}/{table}"

    def read(self, table: str, among: list[Segment], schema, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows in these segments, with the last batch of the segment; those of some buckets read no other files."""
        whole = None
        for s in among:
            part = self.spark.read.schema(schema).parquet(self.folder(s, table))
            part = (part if buckets is None else part.filter(F.col("bucket").isin(buckets))).withColumn("last", F.lit(s[1]))
            whole = part if whole is None else whole.unionAll(part)
        return self.spark.createDataFrame([], schema).withColumn("last", F.lit(0)) if whole is None else whole

    def write(self, df: DataFrame, segment: Segment, table: str) -> None:
        df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.folder(segment, table))

    def complete(self, segment: Segment) -> bool:
        """Whether all tables of a segment are written: the market rows are the last."""
        return written(self.spark, self.folder(segment, "market"))

    def there(self) -> list[Segment]:
        """All complete segments."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/segment=*/market/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        names = [f.getPath().getParent().getParent().getName() for f in found or []]
        return sorted(tuple(map(int, n.removeprefix("segment=").split("-"))) for n in names)

    def drop(self, segment: Segment) -> None:
        delete(self.spark, f"{self.target}/segment={segment[0]}-{segment[1]}")


def merged(table: str, rows: DataFrame) -> DataFrame:
    """Rows of several segments as one row a key: prices count together, sellers once, sums add up."""
    if table == "prices":
        return rows.groupBy("bucket", "product_id", "cents").agg(F.sum("times").alias("times"))
    if table == "sellers":
        return rows.groupBy("bucket", "product_id", "seller_id").agg(F.lit(1).alias("one")).drop("one")
    sums = [c for c in rows.columns if c not in ("bucket", "product_id", "last")]
    return rows.groupBy("bucket", "product_id").agg(*[F.sum(c).alias(c) for c in sums])


def delta(facts: DataFrame) -> dict[str, DataFrame]:
    """The state of a batch's own facts, by table."""
    key = ["bucket", "product_id"]
    return {
        "prices": facts.filter("cents IS NOT NULL").groupBy(*key, "cents").agg(F.count("*").alias("times")),
        "sellers": facts.filter("seller_id IS NOT NULL").select(*key, "seller_id").distinct(),
        "sums": facts.groupBy(*key).agg(*[a.alias(k) for k, a in mkt.sums_of_facts().items()]),
    }


def rows_of(state: dict[str, DataFrame]) -> DataFrame:
    """K9 from the state of some products."""
    sellers = state["sellers"].groupBy("product_id").agg(F.count("*").alias("total_sellers"))
    sums = state["sums"].drop("bucket").join(sellers, "product_id", "left").withColumn("total_sellers", F.coalesce("total_sellers", F.lit(0)))
    return mkt.market_rows(sums.join(mkt.counted_places(state["prices"].drop("bucket")), "product_id"))


def add_batch(state: State, batch: DataFrame, number: int) -> None:
    """Batch `number` of the listings: one new segment, with the market rows of its products. A batch whose predecessors are missing is an error."""
    before, new = segments(number), segments(number + 1)[-1]
    if lost := [s for s in before if not state.complete(s)]:
        raise RuntimeError(f"{state.target} lacks batches {lost}: the checkpoint and the target don't belong together")
    replaced = [s for s in before if s[0] >= new[0]]
    own = delta(state.bucketed(mkt.facts_of(batch)))
    for table, rows in own.items():
        old = state.read(table, replaced, rows.schema).drop("last")
        state.write(merged(table, rows.unionByName(old)) if replaced else rows, new, table)
    touched = materialize(own["sums"].select("bucket", "product_id"), "touched")
    buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most `buckets` numbers
    known = {}
    for table, rows in own.items():
        part = state.read(table, segments(number + 1), rows.schema, buckets).join(touched.drop("bucket"), "product_id", "left_semi")
        known[table] = merged(table, part)
    market = state.bucketed(rows_of(known))
    if replaced:
        kept = newest(state.read("market", replaced, market.schema)).join(touched.drop("bucket"), "product_id", "left_anti")
        market = market.unionByName(kept)
    state.write(market, new, "market")
    live = {*before, *segments(number + 1)}
    for s in state.there():  # what the batch before last has replaced; a batch that runs again needs those before it
        if s not in live and s[1] <= number:
            state.drop(s)


def newest(rows: DataFrame) -> DataFrame:
    """Of each product the row of its newest segment."""
    own = [c for c in rows.columns if c != "last"]
    return rows.groupBy("product_id").agg(F.max_by(F.struct(*own), "last").alias("row")).select("row.*")


def stream_market(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files: int = 40, buckets: int = BUCKETS) -> StreamingQuery:
    """Each batch of files adds its listings to the state under target and makes market rows for the products in it.

    A run that stops resumes after its last batch. Ends when no files are left.
    """
    state = State(spark, target, buckets)

    def add(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            add_batch(state, batch, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_market(spark: SparkSession, target: str, number: int | None = None) -> DataFrame:
    """The market rows after a batch, the last one unless it is named (of earlier ones, only the one before is sure to be there still)."""
    state = State(spark, target)
    there = state.there()
    if not there:
        raise RuntimeError(f"{target} has no batches yet")
    number = max(s[1] for s in there) if number is None else number
    among = segments(number + 1)
    schema = spark.read.parquet(state.folder(among[-1], "market")).schema
    return newest(state.read("market", among, schema)).drop("bucket")
