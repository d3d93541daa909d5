"""Batched forests against trees grown one by one in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import forests as fo
from seriesloom.operators.folds import Fold

FOLDS = [Fold(1, 119, 121), Fold(2, 120, 122, train_from=104)]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = []
    for e in range(12):
        for t in range(100, 123):
            x = rng.normal(size=4).round(2)
            rows.append((f"e{e}", t, float(3 * (x[0] > 0) + x[1] * (x[2] > 0.5) + 0.1 * rng.normal()), x.tolist()))
    return spark.createDataFrame(rows, "entity string, period int, y double, x array<double>")


@pytest.fixture(scope="module")
def cells(frame):
    return fo.binned(frame, ["entity"], 119, "test-bins")


@pytest.fixture(scope="module")
def grown(cells):
    rows, n = cells
    pools = [fo.Pool(i, f, 30, m, s) for i, (f, m, s) in enumerate([(FOLDS[0], 4, 5), (FOLDS[0], 2, 20), (FOLDS[1], 3, 10)])]
    return fo.grow(rows, n, pools), pools


def held(cells):
    pdf = cells[0].toPandas().sort_values(["entity", "period"]).reset_index(drop=True)
    return pdf, np.stack([np.frombuffer(b, np.uint8) for b in pdf["b"]])


def plain_tree(trees, root, pool, b, y, in_bag):
    """Nodes of one tree by search over all cuts: {path: (size, value, feature, cut)}."""
    out = {}

    def go(node, mine):
        n, s = len(mine), y[mine].sum()
        out[node] = (n, s / n)
        if trees.feature[node] < 0:
            best = None
            if n > pool.node_size:
                best = best_cut(node, mine, n, s)
            assert best is None or best[0] <= 1e-9 * max(1.0, s * s / n) * 2
            return
        gain, feature, cut = best_cut(node, mine, n, s)
        assert gain == pytest.approx(trees.gain[node], rel=1e-9)
        assert n > pool.node_size
        chosen = b[mine, trees.feature[node]] <= trees.cut[node]
        assert trees.feature[node] in trees.tried(np.array([node]), np.array([pool.mtry]))[0]
        go(trees.left[node], mine[chosen])
        go(trees.left[node] + 1, mine[~chosen])

    def best_cut(node, mine, n, s):
        best = (-np.inf, 0, 0)
        for f in trees.tried(np.array([node]), np.array([pool.mtry]))[0]:
            for cut in range(fo.BINS - 1):
                left = mine[b[mine, f] <= cut]
                if 0 < len(left) < n:
                    sl = y[left].sum()
                    gain = sl**2 / len(left) + (s - sl) ** 2 / (n - len(left)) - s * s / n
                    best = max(best, (gain, f, cut))
        return best if np.isfinite(best[0]) else (0.0, 0, 0)

    go(root, np.flatnonzero(in_bag))
    return out


def test_every_split_is_the_best_of_those_tried(cells, grown):
    trees, pools = grown
    pdf, b = held(cells)
    y, h, period = pdf["y"].to_numpy(), pdf["h"].to_numpy(), pdf["period"].to_numpy()
    for pool in pools:
        lo, hi = trees.span[pool.number]
        train = (period <= pool.fold.train_to) & (period >= (pool.fold.train_from or 0))
        bags = trees.in_bag(h, lo, hi) & train[:, None]
        assert abs(bags[train].mean() - fo.SHARE) < 0.05
        for root in (lo, lo + 7, hi - 1):
            nodes = plain_tree(trees, root, pool, b, y, bags[:, root - lo])
            assert len(nodes) > 1
            for node, (n, mean) in nodes.items():
                assert trees.size[node] == n and trees.value[node] == pytest.approx(mean)
    shares = trees.importance()
    assert all(g.sum() == pytest.approx(1) for g in shares.values()) and shares[0].argmax() == 0


def test_small_forests_are_part_of_large_ones(spark, cells, grown):
    rows, n = cells
    trees, pools = grown
    alone = fo.Pool(9, FOLDS[0], 12, 4, 40)
    own = fo.grow(rows, n, [alone])
    a = fo.predictions(rows, ["entity"], own, [fo.Reading(0, 9, 12, 40)]).toPandas().sort_values("entity")
    b = fo.predictions(rows, ["entity"], trees, [fo.Reading(0, 0, 12, 40)]).toPandas().sort_values("entity")
    assert len(a) == 12 and np.allclose(a["response"], b["response"]) and set(a["set"]) == {"test"}
    both = fo.predictions(rows, ["entity"], trees, [fo.Reading(5, 2, 30, 10)], with_train=True).toPandas()
    assert both.groupby("set").size().to_dict() == {"test": 12, "train": 12 * 17} and both["se"].isna().all()


def test_jackknife_against_direct_sums(cells, grown):
    trees, pools = grown
    pdf, b = held(cells)
    got = fo.predictions(cells[0], ["entity"], trees, [fo.Reading(p.number, p.number, 30, p.node_size) for p in pools], errors=True).toPandas()
    for pool in pools:
        lo, hi = trees.span[pool.number]
        period = pdf["period"].to_numpy()
        train = (period <= pool.fold.train_to) & (period >= (pool.fold.train_from or 0))
        counts = trees.in_bag(pdf["h"].to_numpy()[train], lo, hi).astype(float)
        at = np.flatnonzero(period == pool.fold.test)
        each = np.array([trees.value[trees.descend(b, np.full(30, i), np.arange(lo, hi), pool.node_size)] for i in at])
        want = {}
        for i, t in zip(at, each):
            cov = ((counts - counts.mean(1, keepdims=True)) * (t - t.mean())).mean(1)
            n, p = int(train.sum()), fo.SHARE
            v = ((cov**2).sum() - n * p * (1 - p) * t.var() / 30) * (n - 1) / n / (1 - p) ** 2
            want[pdf["entity"][i]] = np.sqrt(v) if v > 0 else None
        mine = got[got["model"] == pool.number].set_index("entity")["se"]
        for entity, se in want.items():
            assert (mine[entity] != mine[entity]) if se is None else mine[entity] == pytest.approx(se, rel=1e-6)


def test_bins_see_no_later_row(spark, frame):
    later = frame.withColumn("x", F.when(F.col("period") > 119, F.transform("x", lambda v: v * 100)).otherwise(F.col("x")))
    one, two = (fo.binned(f, ["entity"], 119, "bins")[0].filter("period <= 119").select("entity", "period", F.hex("b")) for f in (frame, later))
    assert one.exceptAll(two).isEmpty()
