"""Whitening of embeddings on their leading principal components, found by Jacobi-Davidson iterations.

The covariance is never formed: its products with a block of vectors are sums over the table of distinct vectors, each
task returning a sum of centred rows' products. A search space grows by corrections: for every wanted Ritz pair the
correction equation, projected against that pair and all locked ones, is solved roughly by a few steps of MINRES whose
products are such distributed ones too; the equations of all pairs advance together, so a pass over the data serves
them all. Rayleigh-Ritz on the space gives new pairs; a pair whose residual has reached double precision is locked, in
falling order of eigenvalues, and a space that is full starts again from its best pairs. The method ends when the wanted
pairs and one guard pair after them are locked; a last Rayleigh-Ritz among them orders them.

The driver holds a few vectors of as many numbers as a vector has entries, never rows. The distinct vectors are written
once, packed as blocks, and read for each pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, table, unused

#: Components; 1 / the width of a level; levels that a long and a double both hold exactly.
COMPONENTS, SCALE, EXACT = 4, 256.0, 2.0**53
#: Pairs beyond the wanted ones that are iterated too; vectors of the search space at most and when it starts again; steps of MINRES; rounds at most.
GUARDS, SPACE, AGAIN, INNER, ROUNDS = 2, 40, 14, 6, 200
#: A residual is at double precision if it is so many roundings of the norm, or as many as a vector has entries.
PRECISE = 64
#: A residual, as a share of the trace, from which on a pair's image is made anew.
FRESH = 1e-9
#: Rows that a block of the written vectors holds; sums of tasks that are added at once.
BLOCK, ADDED = 4096, 64
EPS = float(np.finfo(float).eps)


@dataclass
class Model:
    """What whitening needs. Columns of `vectors` are components by falling eigenvalue; one whose eigenvalue is 0 to double precision has none of its own direction, its values are null."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def full(self) -> np.ndarray:
        """Components with an eigenvalue that isn't 0."""
        return self.values > len(self.sums) * EPS * max(self.values.max(initial=0.0), 0.0)


def levels(embedding: str, size: int | None = None) -> Column:
    """A vector's entries as long levels, floor(256 c); null for vectors that are null, empty, not of the size, or hold null or non-finite entries or ones whose level a double doesn't hold exactly."""
    c = F.col(embedding).cast("array<double>")
    sound = F.forall(c, lambda v: v.isNotNull() & (F.abs(v * SCALE) < EXACT)) & (F.size(c) > 0)
    if size is not None:
        sound = sound & (F.size(c) == size)
    return F.when(sound, F.transform(c, lambda v: F.floor(v * SCALE)))


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK vectors: their number and their entries, one after another."""
    held, n = [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate(held).astype("<f8").tobytes()], pa.binary())], ["n", "x"])

    for b in batches:
        if b.num_rows:
            x = _rows(b.column(0))
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                held, n = [*held, part], n + len(part)
                if n >= BLOCK:
                    yield block()
                    held, n = [], 0
    if n:
        yield block()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for n, x in zip(b.column(0).to_pylist(), b.column(1)):
            yield np.frombuffer(x.as_buffer(), "<f8").reshape(n, -1)


def _sum(of: Callable[[np.ndarray], np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: the sum of `of` over its blocks."""
    total: np.ndarray | float = 0.0
    for x in _blocks(batches):
        total = total + of(x)
    if isinstance(total, np.ndarray):
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for at in range(0, b.num_rows, ADDED):
            x = _rows(b.column(0).slice(at, ADDED)).sum(0)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])


def summed(blocks: DataFrame, tasks: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `of` over all blocks, which so many tasks read: a row a task, added in tasks of ADDED rows until few are left. Bounded by the result's size, not by the table."""
    rows = blocks.mapInArrow(partial(_sum, of), "s array<double>")
    while tasks > ADDED:
        tasks = -(-tasks // ADDED)
        rows = rows.repartition(tasks).mapInArrow(_add, "s array<double>")
    return np.sum([r.s for r in rows.collect()], axis=0)


def _product(mean: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    y = x - mean
    return y.T @ (y @ b)


def _squares(mean: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.square(x - mean).sum(0)


def _second_moments(mean: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    w = (x - mean) @ b
    return np.vstack([w.T @ w, w.sum(0)])


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Unit vectors that span `new` besides what it is against; directions that are nothing but rounding are left out."""
    out = np.empty((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            for a in (*against, out):
                v = v - a @ (a.T @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-8 * size:
            v = v / left
            for a in (*against, out):
                v = v - a @ (a.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int) -> np.ndarray:
    """Columns x that make |rhs - A x| small after so many steps, for a symmetric A a column; `apply` maps all columns at once."""
    beta = np.linalg.norm(rhs, axis=0)
    safe = lambda v: np.where(v > 0, v, 1.0)
    v, before = rhs / safe(beta), np.zeros_like(rhs)
    x, d1, d2 = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    c1, s1, c2, s2 = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    eta, last, first = beta.copy(), np.zeros_like(beta), safe(beta)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - last * before
        new = np.linalg.norm(p, axis=0)
        # the tridiagonal matrix's column, turned by the last two rotations and a new one
        r3, rest = s2 * last, c2 * last
        r2, diagonal = s1 * alpha + c1 * rest, c1 * alpha - s1 * rest
        r1 = np.hypot(diagonal, new)
        live = live & (r1 > EPS * first * 1e-6)
        c, s = np.where(live, diagonal / safe(r1), 1.0), np.where(live, new / safe(r1), 0.0)
        d = (v - r2 * d1 - r3 * d2) / safe(r1)
        x = x + np.where(live, c * eta, 0.0) * d
        eta = np.where(live, -s * eta, eta)
        d2, d1, c2, s2, c1, s1 = d1, d, c1, s1, c, s
        live = live & (new > EPS * np.abs(alpha)) & (np.abs(eta) > 1e-3 * first)
        before, v, last = v, p / safe(new), new
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, bound: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the greatest `wanted` eigenvalues of a symmetric matrix known by its products with blocks. bound: of its norm, such as its trace."""
    guards = min(wanted + GUARDS, size) - wanted
    rng = np.random.default_rng(seed)
    locked, space, images = np.empty((size, 0)), np.empty((size, 0)), np.empty((size, 0))
    new = _orthonormal(rng.standard_normal((size, wanted + guards)))
    for _ in range(ROUNDS):
        space, images = np.column_stack([space, new]), np.column_stack([images, product(new)])
        h = space.T @ images
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, moved = space @ turn, images @ turn
        residuals = moved - vectors * values
        fresh = np.flatnonzero(np.linalg.norm(residuals[:, : wanted + guards], axis=0) <= FRESH * bound)
        if len(fresh):  # images that were turned again and again have lost digits: those of nearly exact pairs are made anew
            exact = vectors[:, fresh] - locked @ (locked.T @ vectors[:, fresh])
            vectors[:, fresh] = exact / np.linalg.norm(exact, axis=0)
            moved[:, fresh] = product(vectors[:, fresh])
            values[fresh] = (vectors[:, fresh] * moved[:, fresh]).sum(0)
            residuals = moved - vectors * values
        residuals = residuals - locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        norm = max(values[0], 0.0) if not locked.shape[1] else norm
        done = 0
        while done < len(values) and locked.shape[1] + done < wanted + min(guards, 1) and sizes[done] <= max(PRECISE, size) * EPS * min(norm, bound):
            done += 1
        if done:
            locked = _orthonormal(np.column_stack([locked, vectors[:, :done]]))
            space, images, values, sizes, residuals = vectors[:, done:], moved[:, done:], values[done:], sizes[done:], residuals[:, done:]
        else:
            space, images = vectors, moved
        if locked.shape[1] >= wanted + min(guards, 1) or locked.shape[1] == size:
            break
        if space.shape[1] > SPACE:
            space, images = space[:, :AGAIN], images[:, :AGAIN]
        k = min(wanted + guards - locked.shape[1], space.shape[1])
        near, shift, rhs = space[:, :k], values[:k], -residuals[:, :k]
        close = sizes[:k] <= 0.1 * np.maximum(np.abs(shift), EPS * norm)  # further off, the residual itself is the better correction

        def projected(t: np.ndarray) -> np.ndarray:
            t = t - locked @ (locked.T @ t)
            return t - near * (near * t).sum(0)

        fix = rhs
        if close.any():
            some = np.flatnonzero(close)
            near, shift = near[:, some], shift[some]
            fix = rhs.copy()
            fix[:, some] = projected(minres(lambda t: projected(product(projected(t)) - shift * projected(t)), projected(rhs[:, some]), INNER))
        new = _orthonormal(np.column_stack([fix, rhs]) if not np.isfinite(fix).all() else fix, locked, space)
        if not new.shape[1]:
            new = _orthonormal(rhs, locked, space)
        if not new.shape[1] and space.shape[1] + locked.shape[1] < size:
            new = _orthonormal(rng.standard_normal((size, 1)), locked, space)
        if not new.shape[1]:
            break  # the space is whole: its pairs are as exact as sums of doubles are
    else:
        raise RuntimeError(f"residuals did not reach double precision in {ROUNDS} rounds: {sizes[:wanted].tolist()}")
    if locked.shape[1] < wanted:
        locked = np.column_stack([locked, space[:, : wanted - locked.shape[1]]])
    h = locked.T @ product(locked)
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return values[::-1][:wanted], (locked @ turn[:, ::-1])[:, :wanted]


def fit(x: DataFrame, components: int = COMPONENTS) -> Model | None:
    """A model of the distinct vectors in x (column x, arrays of one length of long levels); None without any."""
    distinct = x.select("x").groupBy("x").count().select("x")  # a common vector meets its copies before the shuffle
    blocks = materialize(distinct.mapInArrow(_pack, "n long, x binary"), "vectors")
    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return None
    sums = exact_sums(blocks)
    mean = np.array([s / n for s in sums])
    size = len(sums)
    tasks = blocks.rdd.getNumPartitions()
    product = lambda b: (summed(blocks, tasks, partial(_product, mean, b)) / n).reshape(size, -1)
    trace = float(summed(blocks, tasks, partial(_squares, mean)).sum() / n)
    k = min(components, size)
    values, vectors = jacobi_davidson(product, size, k, trace) if trace > 0 else (np.zeros(k), np.eye(size)[:, :k])
    model = Model(n, sums, values, vectors, values / trace if trace > 0 else np.zeros(k), 0.0)
    if (full := model.full).any():
        scaled = vectors[:, full] / np.sqrt(values[full])
        m = summed(blocks, tasks, partial(_second_moments, mean, scaled)).reshape(full.sum() + 1, -1)
        model.identity_error = float(np.abs(m[:-1] / n - np.outer(m[-1], m[-1]) / n**2 - np.eye(int(full.sum()))).max())
    return model


def _parts(x: np.ndarray) -> np.ndarray:
    """Sums of rows in two exact parts: of multiples of 2^26, and of what is left."""
    high = np.floor(x / 2.0**26)
    return np.concatenate([high.sum(0), (x - high * 2.0**26).sum(0)])


def exact_sums(blocks: DataFrame) -> list[int]:
    """Sums of every dimension as whole numbers, exact up to 2^26 vectors a task and beyond that for levels below 2^26."""
    rows = blocks.mapInArrow(partial(_sum, _parts), "s array<double>")
    parts = rows.select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # two a dimension
    by = {r.k: int(r.s) for r in parts}
    size = len(by) // 2
    return [by[k] * 2**26 + by[size + k] for k in range(size)]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2, exact; None beyond a long."""
    rough = np.square(n * x.astype(float) - np.array(sums, float)).sum(1)
    if rough.max(initial=0) < 2.0**62:
        return np.square(n * x - np.array(sums, np.int64)).sum(1).tolist()
    exact = np.square(n * x.astype(object) - np.array(sums, object)).sum(1)
    return [int(v) if v < 2**63 else None for v in exact]


def _project(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    full = model.full
    scaled = np.where(full, model.vectors / np.sqrt(np.where(full, model.values, 1.0)), 0.0)
    mean = np.array([s / model.n for s in model.sums])
    for b in small(batches, 2000):
        x = _rows(b.column("x")).astype(np.int64)
        w = (x - mean) @ scaled
        cells = [[None if not f else float(v) for v, f in zip(row, full)] for row in w]
        found = pa.StructArray.from_arrays([pa.array(_deviations(x, model.n, model.sums), pa.int64()), pa.array(cells, pa.list_(pa.float64()))], ["deviation", "whitened"])
        yield pa.RecordBatch.from_arrays([b.column("row"), found], ["row", "found"])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Model | None]:
    """Rows of vectors (embedding and any other columns) that can be whitened, with one more column, `white` (underscores follow where vectors has it): deviation and the whitened values by component; and the model.

    Left out are rows whose embedding is null, empty, of another length than most have (of equally common lengths the
    greatest), or holds null or non-finite entries or ones of 2^45 and more. Repeated rows stay, and count once in the
    model. Components are as many as vectors have entries at most; those of eigenvalue 0 (equal vectors, fewer vectors
    than components) have null values; a deviation beyond a long is null. An empty table gives no rows and no model.
    """
    name = unused(vectors, "white")
    sizes = vectors.filter(levels("embedding").isNotNull()).groupBy(F.size("embedding").alias("size")).count()
    usual = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    plain = vectors.select(F.struct(*(F.col(f"`{c}`") for c in vectors.columns)).alias("row"), levels("embedding", usual.size if usual else 0).alias("x")).filter("x IS NOT NULL")
    model = fit(plain, components)
    kind = "struct<deviation:long,whitened:array<double>>"
    if model is None:
        found = plain.limit(0).select("row", F.lit(None).cast(kind).alias("found"))
    else:
        schema = plain.select("row", F.lit(None).cast(kind).alias("found")).schema
        found = plain.mapInArrow(partial(_project, model), schema)
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in vectors.columns), F.col("found").alias(name)), model


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white, model = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = white.select("vec_id", "white.deviation", F.posexplode("white.whitened").alias("k", "whitened"))
    explained = F.element_at(F.array(*(F.lit(float(e)) for e in model.explained)) if model else F.array(F.lit(0.0)), F.col("k") + 1)
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))
