"""Near-duplicate embeddings by product quantisation.

Equal vectors are one representative with a count. A bounded sample of representatives (SAMPLE, those with the least
hashes of their ids) fits the coarse centres and, on residuals, one code book per subspace; every representative is
then indexed: its nearest centre's list, its codes, and the length of what the codes miss. As a query it is sent to
its nearest centres, as many as find 99.9 % of the sample's own links. A list's rows are judged by table look-up
of the query's residual; by the triangle inequality none is passed over whose distance less its codes' error is
within reach. What is left is compared by exact cosine in double precision.

The sample bounds the first lists, so a list of over LEAF rows is parted in turn, level by level, by centres fitted on
rows of its own: lists grow in number with the table. A query that visits a list goes on to those of its parts whose
border with its nearest part is near enough to find 99.9 % of the list's own links. A list of which most queries would
visit most parts (one dense group) stays whole.

Lists and their queries are dealt to cells of about CELL rows each, so that no list, however large, meets in one
task. A cell returns a row per representative at most: how many rows it links to, and the least one it is tied to.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, materialize, table

COSINE, SAMPLE, CELL = 0.9, 12_288, 1024
SUBSPACES, CODES, FOUND = 8, 64, 0.999
LEAST_PROBES, MOST_LISTS = 4, 768
#: Rows above which a list is parted; its parts at most; its rows that these are fitted on; links of theirs from which on they tell how far to look.
LEAF, BRANCH, OWN_SAMPLE, ENOUGH_LINKS = 4096, 64, 2048, 1000
#: A list's number: its part among all parts of its level, times DEPTHS, plus its level, times TOPS, plus its first list.
DEPTHS, TOPS = 8, 1024
SEED = 7


def unit(rows, width: int | None = None) -> np.ndarray:
    """Rows as unit vectors in double precision; short ones end in zeros."""
    width = width or max(map(len, rows), default=1)
    x = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres; the same for the same rows."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([(part @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for part in np.array_split(x, -(-len(x) // 2048))])
        size = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    d = 0.5 * (centres * centres).sum(1) - x @ centres.T
    n = min(n, len(centres))
    some = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(n), (len(x), 1))
    return np.take_along_axis(some, np.take_along_axis(d, some, 1).argsort(1, kind="stable"), 1)


class Index:
    """Centres, code books and number of probes."""

    def __init__(self, sample: np.ndarray, total: int, cosine: float) -> None:
        self.width, self.cosine, self.reach = sample.shape[1], cosine, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        self.cuts = np.linspace(0, self.width, min(SUBSPACES, self.width) + 1).astype(int)
        self.centres = means(sample, max(1, min(MOST_LISTS, int(2 * total**0.5), len(sample) // 8)))
        rest = sample - self.centres[nearest(sample, self.centres, 1)[:, 0]]
        self.books = [means(np.ascontiguousarray(rest[:, a:b]), CODES, 8) for a, b in zip(self.cuts, self.cuts[1:])]
        self.probes = self._enough(sample)

    def _enough(self, x: np.ndarray) -> int:
        """The least number of probes with which the sample's linked pairs are found from one side or the other."""
        order = nearest(x, self.centres, len(self.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(x), 0), 1)
        seen = np.zeros(len(self.centres), np.int64)
        y = x.astype(np.float32)
        for at in range(0, len(x), 1024):
            i, j = np.nonzero(y[at : at + 1024] @ y.T >= self.cosine)
            i += at
            for k in range(0, len(i), 1 << 20):
                a, b = i[k : k + (1 << 20)], j[k : k + (1 << 20)]
                a, b = a[a < b], b[a < b]
                seen += np.bincount(np.minimum(place[a, order[b, 0]], place[b, order[a, 0]]), minlength=len(seen))
        share = np.cumsum(seen) / max(1, seen.sum())
        return int(min(len(self.centres), max(LEAST_PROBES, 1 + np.argmax(share >= FOUND) if seen.sum() else 2 * LEAST_PROBES)))

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what they miss."""
        codes, miss = np.empty((len(rest), len(self.books)), np.uint8), np.zeros(len(rest))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            codes[:, m] = nearest(rest[:, a:b], book, 1)[:, 0]
            miss += ((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(miss)

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of queries' residuals to coded rows, by look-up."""
        d = np.zeros((len(rest), len(codes)))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            looked = ((rest[:, None, a:b] - book[None]) ** 2).sum(2)
            d += looked[:, codes[:, m]]
        return np.sqrt(d)


def _place(index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ix = index.value
    for b in batches:
        x = unit(b.column(2).to_pylist(), ix.width)
        probes = nearest(x, ix.centres, ix.probes)
        codes, miss = ix.code(x - ix.centres[probes[:, 0]])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(probes[:, 0], pa.int64()), pa.array(probes.tolist(), pa.list_(pa.int64())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(miss)], ["rep", "n", "embedding", "home", "probes", "codes", "miss"])


def borders(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how far the row is from the border between that one's part and each other's."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)
    first = d.argmin(1)
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    return first, (d - np.take_along_axis(d, first[:, None], 1)) / np.maximum(2 * apart[first], 1e-12)


def _part(index, leaf: int, group: pd.DataFrame) -> pd.DataFrame:
    """Centres of a list's parts from rows of its own, and how far across borders to look; no row if that would be nearly everywhere."""
    ix, x = index.value, unit(group.embedding.tolist(), index.value.width)
    centres = means(x, min(BRANCH, -(-int(group["rows"].iloc[0]) // leaf)))
    first, far = borders(x, centres)
    y = x.astype(np.float32)
    i, j = np.nonzero(np.triu(y @ y.T >= ix.cosine, 1))
    # two rows within reach lie on both sides of a border: one of them is within half of it
    look = min(ix.reach, float(np.quantile(np.concatenate((far[i, first[j]], far[j, first[i]])), FOUND))) if len(i) >= ENOUGH_LINKS else ix.reach / 2
    if (far <= look).mean() > 0.5:
        return pd.DataFrame({"list": [], "centres": [], "look": []}, dtype=object)
    return pd.DataFrame({"list": [group.home.iloc[0]], "centres": [centres.ravel()], "look": [look]})


def _visit(index, group: pd.DataFrame) -> pd.DataFrame:
    """The parts of a list that its visitors go on to, their nearest first."""
    told, rows = group[group.centres.notna()], group[group.centres.isna()]
    if told.empty or rows.empty:
        return pd.DataFrame({"rep": [], "list": [], "parts": []}, dtype=object)
    at, centres = int(group.list.iloc[0]), np.asarray(told.centres.iloc[0]).reshape(-1, index.value.width)
    first, far = borders(unit(rows.embedding.tolist(), index.value.width), centres)
    np.put_along_axis(far, first[:, None], -1.0, 1)
    top, level, path = at % TOPS, at // TOPS % DEPTHS, at // TOPS // DEPTHS
    number = lambda k: ((path * (BRANCH + 1) + k + 1) * DEPTHS + level + 1) * TOPS + top
    parts = [[number(int(k)) for k in f.argsort(kind="stable")[: int((f <= told.look.iloc[0]).sum())]] for f in far]
    return pd.DataFrame({"rep": rows.rep.to_numpy(), "list": at, "parts": parts})


def grow(placed: DataFrame, index, leaf: int = LEAF) -> DataFrame:
    """Part lists of over `leaf` rows, and send their visitors on to the parts, level by level until none is left to part."""
    for level in range(DEPTHS - 1):
        large = placed.groupBy("home").agg(F.count("*").alias("rows")).filter((F.col("rows") > leaf) & (F.floor(F.col("home") / TOPS) % DEPTHS == level))
        # a share of each list by a hash, half as much again as is wanted, is cut to it: no list is sorted whole
        drawn = F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(1 << 40)) / float(1 << 40) < F.lit(1.5 * OWN_SAMPLE) / F.col("rows")
        order = Window.partitionBy("home").orderBy(F.xxhash64("rep"), "rep")
        own = placed.join(large, "home").filter(drawn).select("home", "rows", "embedding", F.row_number().over(order).alias("r")).filter(F.col("r") <= OWN_SAMPLE)
        parts = materialize(own.groupBy("home").applyInPandas(partial(_part, index, leaf), "list long, centres array<double>, look double"), "parts")
        if parts.isEmpty():
            return placed
        asked = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
        blocks = materialize(parts.select("list").join(asked, "list"), "blocks")
        visits = placed.select("rep", "embedding", F.explode("probes").alias("list")).join(blocks, "list")
        visits = visits.select("list", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", "embedding", F.lit(None).cast("array<double>").alias("centres"), F.lit(None).cast("double").alias("look"))
        told = parts.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("rep"), F.lit(None).cast("array<double>").alias("embedding"), "centres", "look")
        onward = visits.unionAll(told).groupBy("list", "block").applyInPandas(partial(_visit, index), "rep long, list long, parts array<long>")
        onward = onward.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("list", "parts"))).alias("onward"))  # as many as a row has probes
        to = lambda p: F.try_element_at("onward", p)
        probes = F.flatten(F.transform("probes", lambda p: F.coalesce(to(p), F.array(p))))
        placed = materialize(placed.join(onward, "rep", "left").select("rep", "n", "embedding", F.coalesce(to(F.col("home"))[0], F.col("home")).alias("home"), probes.alias("probes"), "codes", "miss"), "placed")
    return placed


def forest(links: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over links."""
    root = np.arange(n)
    while True:
        was = root.copy()
        np.minimum.at(root, links[0], was[links[1]])
        np.minimum.at(root, links[1], was[links[0]])
        root = root[root]
        if (root == was).all():
            return root


def _cell(index, group: pd.DataFrame) -> pd.DataFrame:
    ix = index.value
    q, d = group[group.query_side].sort_values("rep"), group[~group.query_side].sort_values("rep")
    none = pd.DataFrame({"rep": [], "root": [], "links": []}, dtype="int64")
    if q.empty or d.empty:
        return none
    x, y = unit(q.embedding.tolist(), ix.width), unit(d.embedding.tolist(), ix.width)
    codes = np.frombuffer(b"".join(d.codes), np.uint8).reshape(len(d), -1)
    near = ix.distances(x - ix.centres[int(group.cell_list.iloc[0]) % TOPS], codes) <= ix.reach + d.miss.to_numpy()[None, :] + 1e-9
    near &= q.rep.to_numpy()[:, None] != d.rep.to_numpy()[None, :]
    rows = np.nonzero(near.any(1))[0]  # exact cosines of the candidates' rows
    i, j = np.nonzero(near[rows] & (x[rows] @ y.T >= ix.cosine))
    i = rows[i]
    if not len(i):
        return none
    # a pair is counted for the query here, and for the listed row too unless that will find it as a query
    homes, at = np.unique(q.home.to_numpy(), return_inverse=True)
    probes = np.concatenate(d.probes.to_numpy())
    k = np.minimum(np.searchsorted(homes, probes), len(homes) - 1)
    asked, visits = homes[k] == probes, np.zeros((len(d), len(homes)), bool)
    visits[np.repeat(np.arange(len(d)), d.probes.map(len))[asked], k[asked]] = True
    back = ~visits[j, at[i]]
    ids = np.unique(np.concatenate((q.rep.to_numpy()[i], d.rep.to_numpy()[j])))
    a, b = np.searchsorted(ids, q.rep.to_numpy()[i]), np.searchsorted(ids, d.rep.to_numpy()[j])
    count = np.zeros(len(ids), np.int64)
    np.add.at(count, a, d.n.to_numpy()[j])
    np.add.at(count, b[back], q.n.to_numpy()[i[back]])
    return pd.DataFrame({"rep": ids, "root": ids[forest((a, b), len(ids))], "links": count})


def links(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding).

    n_links: other rows found at this cosine or more; component_id: the least vec_id reachable over such links;
    kept: vec_id = component_id. Vectors that are null, empty or zero, or hold null or non-finite components,
    and rows with a null vec_id, link with nothing. Rows that share a vec_id are one node. Vectors of other
    lengths are compared as if they ended in zeros. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    given = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    given = given.withColumn("good", good)
    reps = materialize(given.filter("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "embedding"), "vectors")
    some = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").collect()  # bounded by `sample`
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")]
    if not some:
        return given.select("vec_id", *alone)
    width = reps.agg(F.max(F.size("embedding"))).first()[0]
    index = spark.sparkContext.broadcast(Index(unit([r.embedding for r in some], width), reps.count(), cosine))
    placed = materialize(reps.mapInArrow(partial(_place, index), "rep long, n long, embedding array<double>, home long, probes array<long>, codes binary, miss double"), "placed")
    placed = grow(placed, index, leaf)
    blocks = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    listed = placed.groupBy(F.col("home").alias("cell_list")).agg(F.count("*").alias("rows"))
    asked = placed.select(F.explode("probes").alias("cell_list")).groupBy("cell_list").agg(F.count("*").alias("queries"))
    sizes = materialize(listed.join(asked, "cell_list").select("cell_list", blocks("rows").alias("row_blocks"), blocks("queries").alias("query_blocks")), "sizes")
    keep = ["rep", "n", "embedding", "home", "probes", "codes", "miss"]
    own = F.pmod(F.xxhash64("rep"), F.col("row_blocks")).cast("int")
    rows = placed.withColumn("cell_list", F.col("home")).join(sizes, "cell_list").withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    own = F.pmod(F.xxhash64("rep"), F.col("query_blocks")).cast("int")
    queries = placed.withColumn("cell_list", F.explode("probes")).join(sizes, "cell_list").withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
    cells = rows.select(F.lit(False).alias("query_side"), "cell_list", "i", "j", *keep).unionAll(queries.select(F.lit(True), "cell_list", "i", "j", *keep))
    found = materialize(cells.groupBy("cell_list", "i", "j").applyInPandas(partial(_cell, index), "rep long, root long, links long"), "links")
    tied = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    count = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = reps.join(count, "rep", "left").join(tied.select(F.col("u").alias("rep"), "v"), "rep", "left")
    classes = materialize(classes.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("v", "rep").alias("component_id")), "classes")
    both = given.filter("good").join(classes, "embedding").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return both.unionAll(given.filter("NOT good").select("vec_id", *alone))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))
