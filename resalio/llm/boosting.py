"""Gradient-boosted trees: logistic loss, quantile bins, Newton leaves; of rows in memory, or of a table that tasks sum."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Gradients are summed as whole numbers of 1 / UNIT: no order of the sums changes a tree.
UNIT = 1 << 24


def _best(sums: np.ndarray, ridge: float, least: int) -> tuple | None:
    """(feature, bin, sums of the left side, of the right one) of the split that gains most; sums: g, h and numbers of rows by feature and bin."""
    left, whole = np.cumsum(sums, axis=2)[:, :, :-1], sums[:, :1].sum(axis=2, keepdims=True)
    right = whole - left
    gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
    gain[np.minimum(left[2], right[2]) < least] = 0
    f, b = (int(k) for k in np.unravel_index(gain.argmax(), gain.shape))
    return (f, b, left[:, f, b], right[:, f, b]) if gain[f, b] > 1e-9 else None


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, n_bins: int, ridge: float, least: int) -> list:
    """A tree as nested lists: [feature, bin, left, right] or a leaf's value. Rows with a bin <= the node's go left."""
    value = -g.sum() / (h.sum() + ridge)
    if depth == 0 or len(g) < 2 * least:
        return value
    found = _best(np.array([[np.bincount(bins[:, f], w, n_bins) for f in range(bins.shape[1])] for w in (g, h, None)]), ridge, least)
    if found is None:
        return value
    left = bins[:, found[0]] <= found[1]
    return [*found[:2], *(_grow(bins[side], g[side], h[side], depth - 1, n_bins, ridge, least) for side in (left, ~left))]


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, n_bins: int = 32, ridge: float = 1.0, least: int = 5) -> dict:
    """A model of P(y = 1 | x): thresholds, base score and trees, as plain lists."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins)[1:-1])) if len(x) else np.array([]) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]).astype(np.int64)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    score, grown = np.full(len(y), base), []
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(bins, p - y, p * (1 - p), depth, n_bins, ridge, least)
        score += rate * _leaf(tree, bins)
        grown.append(tree)
    return {"cuts": [c.tolist() for c in cuts], "base": base, "rate": rate, "trees": grown}


def _leaf(tree, bins: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(bins), tree)
    f, b, low, high = tree
    left = bins[:, f] <= b
    out = np.empty(len(bins))
    out[left], out[~left] = _leaf(low, bins[left]), _leaf(high, bins[~left])
    return out


def binned(model: dict, x: np.ndarray) -> np.ndarray:
    """Each row's bins, one byte a feature."""
    x = np.asarray(x, float).reshape(-1, len(model["cuts"]))
    return np.column_stack([np.searchsorted(np.array(c), x[:, f], "left") for f, c in enumerate(model["cuts"])]).astype(np.uint8)


def judged(model: dict, bins: np.ndarray) -> np.ndarray:
    """P(y = 1) of rows of bins."""
    score = np.full(len(bins), model["base"])
    for tree in model["trees"]:
        score += model["rate"] * _leaf(tree, bins)
    return 1 / (1 + np.exp(-score))


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """P(y = 1) of each row."""
    return judged(model, binned(model, x))


def by_kind(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each kind, the first column."""
    kinds = batch.column(0).to_numpy()
    for kind in np.unique(kinds):
        yield int(kind), batch.take(pa.array(np.nonzero(kinds == kind)[0]))


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of equal length, one a row."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _binned(models: dict[int, dict], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind, b in by_kind(batch):
            bins = [row.tobytes() for row in binned(models[kind], matrix(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins, pa.binary()), b.column(2), b.column(3)], ["kind", "bins", "y", "n"])


def _sums(models: dict[int, dict], splits: dict[tuple[int, int], tuple[int, int]], level: int, n_bins: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums for the nodes of a level (the root is 1, a node's sides are 2 node and 2 node + 1): kind, node, place (feature and bin), g, h, n."""
    total: dict = {}
    for batch in batches:
        for kind, b in by_kind(batch):
            bins = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            p, y, n = judged(models[kind], bins), b.column(2).to_numpy(), b.column(3).to_numpy()
            weights, node = (np.rint((p - y) * UNIT) * n, np.rint(p * (1 - p) * UNIT) * n, n), np.ones(len(p), np.int64)
            for (k, at), (f, cut) in sorted(splits.items()):  # a node comes before its sides
                if k == kind:
                    here = node == at
                    node[here] = 2 * at + (bins[here, f] > cut)
            places = bins + n_bins * np.arange(bins.shape[1])
            for at in np.unique(node[node >= 1 << level]).tolist():
                here = node == at
                flat = places[here].ravel()
                total[kind, at] = total.get((kind, at), 0) + np.array([np.bincount(flat, np.repeat(w[here], bins.shape[1]), n_bins * bins.shape[1]) for w in weights])
    for (kind, at), sums in total.items():
        place = np.nonzero(sums[2])[0]
        columns = [np.full(len(place), kind), np.full(len(place), at), place, *sums[:, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["kind", "node", "place", "g", "h", "n"])


def _tree(splits: dict, leaves: dict, kind: int, node: int = 1) -> list | float:
    if (kind, node) in leaves:
        return leaves[kind, node]
    return [*splits[kind, node], *(_tree(splits, leaves, kind, 2 * node + side) for side in (0, 1))]


def boosted(rows: DataFrame, trees: int = 40, depth: int = 3, rate: float = 0.2, n_bins: int = 32, ridge: float = 1.0, least: int = 5) -> dict[int, dict]:
    """What boost makes of each kind of rows (kind, x, y, and n: how many such rows there are), from all of them.

    Every level of a tree is one pass, for all kinds at once: tasks sum the gradients of their rows by node, feature
    and bin, and the sums meet by these. The driver gets as many sums as there are nodes and bins, never rows.
    """
    values = rows.select("kind", "n", F.posexplode("x").alias("feature", "value")).groupBy("kind", "feature", "value").agg(F.sum("n").alias("n"))
    cuts = values.groupBy("kind", "feature").agg(F.percentile("value", np.linspace(0, 1, n_bins)[1:-1].tolist(), F.col("n")).alias("cuts"))
    models: dict[int, dict] = {}
    for r in rows.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y")).collect():
        models[r.kind] = {"cuts": [], "base": float(np.log((r.y + 0.5) / (r.n - r.y + 0.5))), "rate": rate, "trees": []}
    for r in cuts.orderBy("kind", "feature").collect():
        models[r.kind]["cuts"].append(np.unique(r.cuts).tolist())
    table = rows.select("kind", "x", "y", "n").mapInArrow(partial(_binned, models), "kind long, bins binary, y long, n long")
    table = materialize(table.groupBy("kind", "bins", "y").agg(F.sum("n").alias("n")), "boosting-rows")
    for _ in range(trees if models else 0):
        splits, leaves, level = {}, {}, 0
        while level < depth and len(leaves) < len(models) + len(splits):
            sums = table.mapInArrow(partial(_sums, models, splits, level, n_bins), "kind long, node long, place long, g long, h long, n long")
            found: dict = {}
            for kind, node, place, *three in zip(*(c.to_pylist() for c in sums.groupBy("kind", "node", "place").agg(F.sum("g"), F.sum("h"), F.sum("n")).toArrow().columns)):
                if (kind, node) not in found:
                    found[kind, node] = np.zeros((3, len(models[kind]["cuts"]) * n_bins))
                found[kind, node][:, place] = three
            for (kind, node), flat in found.items():
                if (kind, node) in leaves:
                    continue
                g, h, n = by_bin = flat.reshape(3, -1, n_bins) / np.array([UNIT, UNIT, 1])[:, None, None]
                best = _best(by_bin, ridge, least)
                if best is None:
                    leaves[kind, node] = float(-g[0].sum() / (h[0].sum() + ridge))
                    continue
                splits[kind, node] = best[:2]
                for side, (g, h, n) in enumerate(best[2:]):
                    if level + 1 == depth or n < 2 * least:
                        leaves[kind, 2 * node + side] = float(-g / (h + ridge))
            level += 1
        for kind, model in models.items():
            model["trees"].append(_tree(splits, leaves, kind))
    return models
