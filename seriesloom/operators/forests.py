"""Forests of many models grown together, level by level, from histograms that Spark sums.

Features are cut into bins once. Every level of every tree of every model and fold is one Spark job: each
task counts its rows into cells of (tree, node, feature, bin), the cells of a block of nodes meet in one
task, which adds them up and finds each node's best split. The driver holds the trees, that is numbers per
node, and never a cell or a row.

Every tree draws its rows without replacement by a hash of row and tree, and every node its features
by a hash of its path. So a tree grown to small nodes contains all trees of larger nodes: a row stops at
the first node that is small enough. A forest of fewer trees is the beginning of a larger one. Candidates that differ
in these two settings only share one pool of trees, and their predictions are exactly those of separate fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.folds import Fold
from seriesloom.sources.panels import stage

BINS = 64
# Share of the training rows that a tree draws.
SHARE = 0.632
# Cells that one task adds up at once, and that a task holds before it passes them on.
BLOCK, HELD = 1 << 20, 1 << 23


@dataclass(frozen=True)
class Pool:
    """Trees of one fold that share the number of features tried per node. Nodes of ``node_size`` rows or fewer stay whole."""

    number: int
    fold: Fold
    trees: int
    mtry: int
    node_size: int


@dataclass(frozen=True)
class Reading:
    """A forest read from a pool: its first ``trees`` trees with nodes of ``node_size``."""

    number: int
    pool: int
    trees: int
    node_size: int


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def binned(frame: DataFrame, keys: list[str], train_to: int, name: str, bins: int = BINS) -> tuple[DataFrame, int]:
    """Rows ``keys, period, y, h, b``: ``h`` a hash of keys and period, ``b`` a byte per feature.

    Bin edges are quantiles of the rows up to ``train_to``, so no later row moves them: features x bins numbers.
    """
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cells = frame.filter(F.col("period") <= train_to).select(F.posexplode("x").alias("i", "v"))
    rows = cells.groupBy("i").agg(F.percentile_approx("v", probs, F.lit(10_000)).alias("edges")).orderBy("i").collect()
    edges = [np.unique(r["edges"]) for r in rows]
    kinds = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            b = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1).astype(np.uint8)
            columns = [*(batch.column(k) for k in keys), batch.column("period"), batch.column("y"), batch.column("h")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in b], pa.binary())], names=[*keys, "period", "y", "h", "b"])

    hashed = frame.select(*keys, "period", "y", F.xxhash64(*keys, "period").alias("h"), "x")
    spread = hashed.repartition(frame.sparkSession.sparkContext.defaultParallelism, "h") if frame.rdd.getNumPartitions() < 2 else hashed
    return stage(spread.mapInArrow(run, f"{kinds}, period int, y double, h long, b binary"), name), len(edges)


class Trees:
    """Nodes of all trees of all pools; the root of tree t is node t."""

    def __init__(self, pools: list[Pool], n_features: int):
        self.pools = {p.number: p for p in pools}
        self.n_features = n_features
        bounds = np.cumsum([0] + [p.trees for p in pools])
        self.span = {p.number: (int(a), int(b)) for p, a, b in zip(pools, bounds, bounds[1:])}
        count = int(bounds[-1])
        self.tree = np.arange(count)
        # a tree's seed depends on its place in the pool alone
        seat = np.concatenate([np.arange(p.trees) for p in pools]) if pools else np.zeros(0, int)
        self.seed = mixed((seat + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.path = mixed(self.seed ^ np.uint64(0x5851F42D4C957F2D))
        self.feature = np.full(count, -1, np.int32)
        self.cut = np.zeros(count, np.int16)
        self.left = np.zeros(count, np.int64)
        self.value = np.zeros(count)
        self.size = np.zeros(count, np.int64)
        self.gain = np.zeros(count)

    def in_bag(self, h: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Which of the trees ``lo`` to ``hi`` draw each row: rows x trees."""
        return mixed(h.view(np.uint64)[:, None] ^ self.seed[None, lo:hi]) < np.uint64(int(SHARE * 2**64))

    def descend(self, b: np.ndarray, row: np.ndarray, node: np.ndarray, least: int = 0) -> np.ndarray:
        """The node in which each pair of a row and a tree's node ends, stopping at nodes of ``least`` rows or fewer."""
        node = node.copy()
        going = np.arange(node.size)
        while going.size:
            at = node[going]
            inner = (self.feature[at] >= 0) & (self.size[at] > least)
            going, at = going[inner], at[inner]
            node[going] = self.left[at] + (b[row[going], self.feature[at]] > self.cut[at])
        return node

    def tried(self, nodes: np.ndarray, mtry: np.ndarray) -> np.ndarray:
        """Features tried at each node: nodes x the largest ``mtry``, -1 beyond a node's own."""
        numbers = mixed(np.arange(1, self.n_features + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(mixed(self.path[nodes][:, None] ^ numbers), axis=1, kind="stable")[:, : int(mtry.max())]
        return np.where(np.arange(order.shape[1])[None, :] < mtry[:, None], order, -1)

    def split(self, nodes: np.ndarray, found: pd.DataFrame) -> np.ndarray:
        """Give nodes their values and splits; the children."""
        at = nodes[found["slot"].to_numpy()]
        n, s = found["n"].to_numpy(), found["s"].to_numpy()
        self.size[at], self.value[at] = n, s / np.maximum(n, 1)
        do = (found["feature"] >= 0).to_numpy() & (n > self._least(at))
        at, found = at[do], found[do]
        first = self.feature.size
        self.feature[at], self.cut[at], self.gain[at] = found["feature"], found["cut"], found["gain"]
        self.left[at] = first + 2 * np.arange(at.size)
        more = 2 * at.size
        left, right = found[["nl", "sl"]].to_numpy(), found[["n", "s"]].to_numpy() - found[["nl", "sl"]].to_numpy()
        both = np.stack([left, right], 1).reshape(more, 2)
        self.tree = np.append(self.tree, np.repeat(self.tree[at], 2))
        side = np.tile(np.array([1, 2], np.uint64), at.size)
        self.path = np.append(self.path, mixed(np.repeat(self.path[at], 2) * np.uint64(3) + side))
        for name, kind in (("feature", -1), ("cut", 0), ("left", 0), ("gain", 0.0)):
            old = getattr(self, name)
            setattr(self, name, np.append(old, np.full(more, kind, old.dtype)))
        self.size = np.append(self.size, both[:, 0].astype(np.int64))
        self.value = np.append(self.value, both[:, 1] / np.maximum(both[:, 0], 1))
        children = first + np.arange(more)
        return children[self.size[children] > self._least(children)]

    def _per_tree(self, what: str) -> np.ndarray:
        return np.concatenate([np.full(p.trees, getattr(p, what)) for p in self.pools.values()])

    def _least(self, nodes: np.ndarray) -> np.ndarray:
        return self._per_tree("node_size")[self.tree[nodes]]

    def importance(self) -> dict[int, np.ndarray]:
        """Share of each feature in the falls of squared error, per pool."""
        out = {}
        for number, (lo, hi) in self.span.items():
            mine = (self.tree >= lo) & (self.tree < hi) & (self.feature >= 0)
            total = np.bincount(self.feature[mine], self.gain[mine], self.n_features)
            out[number] = total / total.sum() if total.sum() > 0 else total
        return out


def _training(fold: Fold, period: np.ndarray) -> np.ndarray:
    mine = period <= fold.train_to
    return mine if fold.train_from is None else mine & (period >= fold.train_from)


def _matrix(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
    return b, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("period", "y", "h"))


def _steps(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            yield whole.slice(lo, rows)


def best_splits(count: np.ndarray, total: np.ndarray, tried: np.ndarray) -> dict[str, np.ndarray]:
    """Best split per node from cells nodes x features tried x bins; feature -1 where none lowers the squared error."""
    n, s = count[:, 0].sum(-1), total[:, 0].sum(-1)
    nl, sl = count.cumsum(-1)[..., :-1], total.cumsum(-1)[..., :-1]
    nr, sr = n[:, None, None] - nl, s[:, None, None] - sl
    with np.errstate(all="ignore"):
        fall = np.where((nl > 0) & (nr > 0), sl * sl / nl + sr * sr / nr, -np.inf).reshape(len(n), -1)
        best = fall.argmax(1)
        gain = fall[np.arange(len(n)), best] - s * s / np.maximum(n, 1)
    j, cut = np.divmod(best, nl.shape[-1])
    at = np.arange(len(n))
    worth = gain > 1e-9 * np.maximum(1.0, np.abs(s * s / np.maximum(n, 1)))
    feature = np.where(worth, tried[at, j], -1)
    return {"n": n, "s": s, "feature": feature, "cut": cut, "gain": np.where(worth, gain, 0.0), "nl": nl[at, j, cut], "sl": sl[at, j, cut]}


def _level(rows: DataFrame, trees: Trees, nodes: np.ndarray) -> pd.DataFrame:
    """Best splits of ``nodes``, which are in order of their trees: one row per node."""
    spark = rows.sparkSession
    mtry = np.minimum(trees._per_tree("mtry"), trees.n_features)[trees.tree[nodes]]
    tried = trees.tried(nodes, mtry)
    width = tried.shape[1] * BINS
    slot = np.full(trees.feature.size, -1, np.int64)
    slot[nodes] = np.arange(nodes.size)
    # blocks of whole trees: (pool, first and last tree, first and last slot)
    owner = trees.tree[nodes]
    blocks = []
    for number, (first, last) in trees.span.items():
        lo = first
        while lo < last:
            a = int(np.searchsorted(owner, lo))
            most = owner[min(a + max(1, BLOCK // width), owner.size) - 1] if a < owner.size else last
            hi = min(last, max(lo + 1, int(most)))
            z = int(np.searchsorted(owner, hi))
            if z > a:
                blocks.append((number, lo, hi, a, z))
            lo = hi
    sent = spark.sparkContext.broadcast((trees, slot, tried, blocks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, slot, tried, blocks = sent.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def pass_on() -> Iterator[pa.RecordBatch]:
            for k, (n, s) in held.items():
                at = np.flatnonzero(n)
                parts = [at.astype(np.int32).tobytes(), n[at].tobytes(), s[at].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["block", "cell", "n", "s"])
            held.clear()

        for batch in _steps(batches):
            b, period, y, h = _matrix(batch, trees.n_features)
            for k, (number, lo, hi, a, z) in enumerate(blocks):
                row, tree = np.nonzero(trees.in_bag(h, lo, hi) & _training(trees.pools[number].fold, period)[:, None])
                own = slot[trees.descend(b, row, tree + lo)]
                row, own = row[own >= 0], own[own >= 0]
                if not row.size:
                    continue
                features = tried[own]
                cells = (own - a)[:, None] * width + np.arange(features.shape[1]) * BINS + b[row[:, None], features]
                used = features >= 0
                size = (z - a) * width
                n = np.bincount(cells[used], minlength=size).astype(float)
                s = np.bincount(cells[used], np.broadcast_to(y[row][:, None], cells.shape)[used], size)
                held[k] = (held[k][0] + n, held[k][1] + s) if k in held else (n, s)
                if sum(v[0].size for v in held.values()) > HELD:
                    yield from pass_on()
        yield from pass_on()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        trees, slot, tried, blocks = sent.value
        current, n, s = None, None, None

        def finish() -> pd.DataFrame:
            _, _, _, a, z = blocks[current]
            shape = (z - a, tried.shape[1], BINS)
            out = best_splits(n.reshape(shape), s.reshape(shape), tried[a:z])
            return pd.DataFrame({"slot": np.arange(a, z)} | out)

        for batch in batches:
            for k, cell, more, sums in zip(*(batch[c] for c in ("block", "cell", "n", "s"))):
                if k != current:
                    if current is not None:
                        yield finish()
                    current = k
                    size = (blocks[k][4] - blocks[k][3]) * width
                    n, s = np.zeros(size), np.zeros(size)
                at = np.frombuffer(cell, np.int32)
                n[at] += np.frombuffer(more)
                s[at] += np.frombuffer(sums)
        if current is not None:
            yield finish()

    cells = rows.select("period", "y", "h", "b").mapInArrow(count, "block int, cell binary, n binary, s binary")
    by_block = cells.repartition("block").sortWithinPartitions("block")
    found = by_block.mapInPandas(choose, "slot long, n double, s double, feature int, cut int, gain double, nl double, sl double")
    out = found.toPandas()  # one row per open node
    sent.destroy()
    return out


def grow(rows: DataFrame, n_features: int, pools: list[Pool], most_levels: int = 64) -> Trees:
    """All trees of all pools. ``rows`` come from ``binned``; features beyond a fold's reach are no matter of this."""
    trees = Trees(pools, n_features)
    nodes = trees.tree
    for _ in range(most_levels):
        if not nodes.size:
            break
        nodes = nodes[np.argsort(trees.tree[nodes], kind="stable")]
        nodes = trees.split(nodes, _level(rows, trees, nodes))
    return trees


def jackknife(rows: DataFrame, trees: Trees) -> dict[int, tuple[int, np.ndarray]]:
    """Per pool the number of training rows and the trees x trees matrix of their in-bag counts' products.

    A row's counts are centred over the trees, so a forecast's covariances with all rows' counts,
    squared and summed, are one quadratic form of this matrix.
    """
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in _steps(batches):
            _, period, _, h = _matrix(batch, trees.n_features)
            for number, (lo, hi) in trees.span.items():
                mine = _training(trees.pools[number].fold, period)
                held = trees.in_bag(h[mine], lo, hi).astype(float)
                held -= held.mean(1, keepdims=True)
                sums[number] = sums.get(number, 0.0) + held.T @ held
                count[number] = count.get(number, 0) + int(mine.sum())
        for number, cells in sums.items():
            columns = [pa.array([number], pa.int32()), pa.array([count[number]], pa.int64()), pa.array([cells.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["pool", "n", "cells"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c) for c in parts["cells"])
        return pd.DataFrame({"pool": [parts["pool"].iloc[0]], "n": [parts["n"].sum()], "cells": [total.tobytes()]})

    kind = "pool int, n long, cells binary"
    found = rows.mapInArrow(run, kind).groupBy("pool").applyInPandas(add, kind).collect()
    return {r["pool"]: (r["n"], np.frombuffer(r["cells"]).reshape(2 * (trees.pools[r["pool"]].trees,))) for r in found}


def standard_error(each: np.ndarray, n: int, products: np.ndarray) -> np.ndarray:
    """Standard errors by the infinitesimal jackknife from forecasts rows x trees.

    The summed squared covariances are freed of what finitely many trees add by chance, and widened for draws without
    replacement (n / (n - drawn))^2. NULL (nan) where nothing is left or fewer than two trees are there.
    """
    size = each.shape[1]
    apart = each - each.mean(1, keepdims=True)
    raw = np.einsum("ri,ij,rj->r", apart, products[:size, :size], apart) / size**2
    chance = n * SHARE * (1 - SHARE) * (apart**2).mean(1) / size
    variance = (raw - chance) * (n - 1) / n / (1 - SHARE) ** 2
    with np.errstate(all="ignore"):
        return np.where((variance > 0) & (size > 1), np.sqrt(variance), np.nan)


def predictions(
    rows: DataFrame, keys: list[str], trees: Trees, readings: list[Reading], with_train: bool = False, errors: bool = False
) -> DataFrame:
    """Test (and training) forecasts of every reading: ``keys, period, model, fold, set, truth, response, se``."""
    products = jackknife(rows, trees) if errors else {}
    sent = rows.sparkSession.sparkContext.broadcast((trees, readings, products))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, readings, products = sent.value
        for batch in _steps(batches, 512):
            b, period, y, _ = _matrix(batch, trees.n_features)
            for reading in readings:
                fold = trees.pools[reading.pool].fold
                for name, mine in (("test", period == fold.test), ("train", _training(fold, period) & with_train)):
                    at = np.flatnonzero(mine)
                    if not at.size:
                        continue
                    first = trees.span[reading.pool][0]
                    row, node = np.repeat(at, reading.trees), np.tile(np.arange(first, first + reading.trees), at.size)
                    each = trees.value[trees.descend(b, row, node, reading.node_size)].reshape(at.size, reading.trees)
                    se = standard_error(each, *products[reading.pool]) if errors else np.full(at.size, np.nan)
                    columns = [batch.column(k).take(pa.array(at)) for k in keys]
                    columns += [pa.array(period[at], pa.int32()), *(pa.array(np.full(at.size, v), pa.int32()) for v in (reading.number, fold.number))]
                    columns += [pa.array([name] * at.size), pa.array(y[at]), pa.array(each.mean(1)), pa.array(se, mask=np.isnan(se))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "period", "model", "fold", "set", "truth", "response", "se"])

    return rows.mapInArrow(run, f"{kinds}, period int, model int, fold int, set string, truth double, response double, se double")
