"""Learners on pooled lag frames: boosted trees, kernel regression, tuning, importance (forests: ``forests``).

One model serves all series of a fold; series differ through their features. A fold is a test
period: training rows end ``gap`` periods before it. The number of fits is candidates times folds,
a small driver-side plan; every fit and every prediction is a Spark job over the staged frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.folds import Fold
from seriesloom.operators.joins import attach_group_stats
from seriesloom.operators.windows import minmax_rescale, top_with_ties
from seriesloom.sources.panels import stage

# Settings of the final refits.
FINAL_FOREST = {"trees": 90, "mtry": 183, "node_size": 95}
FINAL_BOOSTING = {"trees": 500, "depth": 9, "rate": 0.025}
FINAL_SVR = {"kernel": "sigmoid", "cost": 0.06}
PARALLEL_FITS = 4


@dataclass
class Fitted:
    """Union of fold predictions and the importance rows of the fold models."""

    predictions: DataFrame
    importance: list[tuple[int, int, float]] = field(default_factory=list)


def test_folds(first_test: int, last_test: int, gap: int, skip: int = 1, width: int | None = None) -> list[Fold]:
    """Rolling origins: one fold per test period, growing unless ``width`` fixes the window."""
    folds = []
    for i, t in enumerate(range(first_test, last_test + 1, skip)):
        end = t - 1 - gap
        folds.append(Fold(i + 1, end, t, None if width is None else end - width + 1))
    return folds


def pooled_frame(frame: DataFrame, features: list[str], target: str, keys: list[str], name: str) -> DataFrame:
    """Complete rows with features as one array, staged so that every fit starts from files."""
    cols = [F.col(c).cast("double") for c in features]
    rows = frame.dropna("any", subset=[target, *features])
    return stage(rows.select(*keys, "period", F.col(target).cast("double").alias("y"), F.array(*cols).alias("x")), name)


def boosting(trees: int, depth: int, rate: float, seed: int = 7) -> Estimator:
    """Squared loss, all rows and columns in every round."""
    return GBTRegressor(
        featuresCol="features", labelCol="y", maxIter=int(trees), maxDepth=int(depth), stepSize=float(rate), subsamplingRate=1.0,
        lossType="squared", seed=seed,
    )


def _members(frame: DataFrame, fold: Fold) -> tuple[DataFrame, DataFrame]:
    train = frame.filter(F.col("period") <= fold.train_to)
    if fold.train_from is not None:
        train = train.filter(F.col("period") >= fold.train_from)
    return train, frame.filter(F.col("period") == fold.test)


def fit_folds(frame: DataFrame, keys: list[str], make: Callable[[], Estimator], folds: list[Fold], with_train: bool = False) -> Fitted:
    """Fit one model per fold, at most four at a time, and predict its test (and training) rows.

    The frame is held in memory and on disk only while the fits pass over it again and again;
    lost blocks come back from the staged files.
    """
    ready = frame.withColumn("features", array_to_vector("x")).persist(StorageLevel.MEMORY_AND_DISK)

    def one(fold: Fold):
        train, test = _members(ready, fold)
        model = make().fit(train)
        parts = [test.withColumn("set", F.lit("test"))]
        if with_train:
            parts.append(train.withColumn("set", F.lit("train")))
        made = [
            model.transform(p).select(*keys, "period", F.lit(fold.number).alias("fold"), "set", F.col("y").alias("truth"), F.col("prediction").alias("response"))
            for p in parts
        ]
        gains = model.featureImportances.toArray()
        return made, [(fold.number, i, float(g)) for i, g in enumerate(gains)]

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        done = list(pool.map(one, folds))
    ready.unpersist()
    frames = [f for made, _ in done for f in made]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return Fitted(out, [row for _, rows in done for row in rows])


def fold_scores(predictions: DataFrame, by: list[str]) -> DataFrame:
    e = F.col("truth") - F.col("response")
    return predictions.filter(F.col("set") == "test").groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n"))


def best_candidate(trials: DataFrame, by: list[str], candidate: str, score: str = "rmse") -> DataFrame:
    """Mean score per candidate over folds and a flag for the lowest (ties: smallest id)."""
    means = trials.groupBy(*by, candidate).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("folds"))
    pick = F.min(F.struct("mean_score", candidate)).alias("_best")
    if by:
        chosen = means.groupBy(*by).agg(pick)
        flagged = attach_group_stats(means, chosen, by)
    else:
        flagged = means.withColumn("_best", means.agg(pick).scalar())
    return flagged.withColumn("is_best", F.col(candidate) == F.col(f"_best.{candidate}")).drop("_best")


def importance_rank(rows: DataFrame, by: list[str], feature: str, gain: str, top: int = 10) -> DataFrame:
    """Mean importance over fold models, rescaled to [0, 1] over all features, then the top with ties."""
    means = rows.groupBy(*by, feature).agg(F.avg(gain).alias("importance"))
    return top_with_ties(minmax_rescale(means, by, "importance"), by, "importance", top, smallest=False)


# --- support-vector regression on kernel features -------------------------------------------


@dataclass
class SvrModel:
    """One (candidate, fold): kernel, cost, tube width and fold bounds."""

    number: int
    kernel: str
    cost: float
    epsilon: float
    fold: Fold
    gamma: float | None = None


def kernel_values(x: np.ndarray, z: np.ndarray, kernel: str, gamma: float) -> np.ndarray:
    inner = x @ z.T
    if kernel == "sigmoid":
        return np.tanh(gamma * inner)
    if kernel == "polynomial":
        return (gamma * inner) ** 3
    if kernel == "radial":
        square = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None, :] - 2 * inner
        return np.exp(-gamma * np.maximum(square, 0.0))
    raise ValueError(f"unknown kernel {kernel}")


def landmark_map(landmarks: np.ndarray, kernel: str, gamma: float) -> np.ndarray:
    """Inverse square root of the landmark kernel. Negative eigenvalues, which a sigmoid kernel
    has, are clipped: the fitted kernel is the nearest positive semidefinite one."""
    values, vectors = np.linalg.eigh(kernel_values(landmarks, landmarks, kernel, gamma))
    keep = values > 1e-8 * max(values.max(), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


@dataclass
class KernelSpace:
    """What a task needs to turn raw features into landmark features: numbers only."""

    mean: np.ndarray
    sd: np.ndarray
    y_mean: float
    y_sd: float
    landmarks: np.ndarray
    gamma: dict[int, float]
    maps: dict[int, np.ndarray]

    def features(self, x: np.ndarray, m: SvrModel) -> np.ndarray:
        phi = kernel_values((x - self.mean) / self.sd, self.landmarks, m.kernel, self.gamma[m.number]) @ self.maps[m.number]
        return np.column_stack([phi, np.ones(len(phi))])


def kernel_space(frame: DataFrame, keys: list[str], models: list[SvrModel], n_landmarks: int) -> KernelSpace:
    """Scaling moments and landmarks from the training rows of the earliest fold, so that no fold
    sees its own test rows. Landmarks are a fixed number of rows, smallest hash first."""
    train, _ = _members(frame, min(models, key=lambda m: m.fold.train_to).fold)
    stats = train.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    rows = stats.orderBy("i").collect()  # one row per feature
    mean, sd = np.array([r["m"] for r in rows]), np.array([r["s"] if r["s"] else 1.0 for r in rows])
    level = train.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s")).first()
    picked = train.orderBy(F.xxhash64(*keys, "period"), *keys, "period").limit(n_landmarks).collect()
    landmarks = (np.array([r["x"] for r in picked]) - mean) / sd
    gamma = {m.number: (m.gamma or 1.0 / len(mean)) for m in models}
    maps = {m.number: landmark_map(landmarks, m.kernel, gamma[m.number]) for m in models}
    return KernelSpace(mean, sd, level["m"], level["s"] or 1.0, landmarks, gamma, maps)


class KernelRegression:
    """Epsilon-insensitive regression on landmark features, for many models in the same jobs.

    Features and target are standardised, so cost and tube width are in units of the target's
    deviation.

    The hinge beside the tube is rounded over ``smooth``, which falls in stages, so that Newton's
    method applies. Each step is one pass over the frame: every task sums, per model and trial point,
    loss, gradient and curvature of its training rows; a grouped sum adds them up and the driver
    solves one small system per model. A model that does not reach ``tolerance`` raises.
    """

    STAGES = (1.0, 0.1, 0.01, 0.001)
    STRIDES = (1.0, 0.4, 0.1, 0.02)

    def __init__(
        self, frame: DataFrame, keys: list[str], models: list[SvrModel], n_landmarks: int = 24, rounds: int = 60, tolerance: float = 1e-6
    ):
        """``n_landmarks`` is the rank of the kernel approximation; ``rounds`` bounds the steps of one stage."""
        self.frame, self.keys, self.models = frame, keys, models
        self.space = kernel_space(frame, keys, models, n_landmarks)
        self.weights = {m.number: np.zeros(self.space.maps[m.number].shape[1] + 1) for m in models}
        self.objective: dict[int, float] = {}
        for smooth in self.STAGES:
            self._settle(smooth, rounds, tolerance)

    def _settle(self, smooth: float, rounds: int, tolerance: float) -> None:
        """Newton steps until no model can gain more than ``tolerance`` of its objective."""
        points = {m.number: [w] for m, w in ((m, self.weights[m.number]) for m in self.models)}
        for _ in range(rounds):
            found = self._sums(points, smooth)
            following = {}
            for m in self.models:
                if m.number not in points:
                    continue
                value, w, gradient, *curvatures = min(
                    (self._whole(m, w, *found.get((m.number, i), self._none(w))) for i, w in enumerate(points[m.number])), key=lambda v: v[0]
                )
                self.weights[m.number], self.objective[m.number] = w, value
                steps = [-np.linalg.lstsq(c + 1e-8 * np.eye(len(w)), gradient, rcond=None)[0] for c in curvatures]
                # what the cautious step, which bounds the loss from above, still promises
                if -gradient @ steps[1] / 2 > tolerance * (1.0 + abs(value)):
                    following[m.number] = [w] + [w + t * step for step in steps for t in self.STRIDES]
            if not following:
                return
            points = following
        raise RuntimeError(f"kernel regression: models {sorted(points)} did not settle in {rounds} steps")

    @staticmethod
    def _none(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        return 0.0, np.zeros(len(w)), np.zeros((len(w), len(w))), np.zeros((len(w), len(w)))

    @staticmethod
    def _whole(m: SvrModel, w: np.ndarray, loss: float, gradient: np.ndarray, *curvatures: np.ndarray) -> tuple:
        ridge = np.ones(len(w))
        ridge[-1] = 1e-9  # the intercept is free
        return 0.5 * w @ (ridge * w) + m.cost * loss, w, ridge * w + m.cost * gradient, *(np.diag(ridge) + m.cost * c for c in curvatures)

    def _sums(self, points: dict[int, list[np.ndarray]], smooth: float) -> dict[tuple[int, int], tuple]:
        models, space = [m for m in self.models if m.number in points], self.space

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                x, y = np.stack(batch["x"].to_numpy()).astype(float), batch["y"].to_numpy(float)
                period = batch["period"].to_numpy()
                for m in models:
                    mine = period <= m.fold.train_to
                    if m.fold.train_from is not None:
                        mine &= period >= m.fold.train_from
                    if not mine.any():
                        continue
                    phi, t = space.features(x[mine], m), (y[mine] - space.y_mean) / space.y_sd
                    for i, w in enumerate(points[m.number]):
                        r = t - phi @ w
                        over = np.abs(r) - m.epsilon
                        inside = (over > 0) & (over < smooth)
                        loss = np.where(inside, over * over / (2 * smooth), np.maximum(over - smooth / 2, 0.0)).sum()
                        gradient = -phi.T @ (np.sign(r) * np.clip(over / smooth, 0.0, 1.0))
                        true = phi[inside].T @ phi[inside] / smooth
                        bound = (phi / np.maximum(np.abs(over), smooth)[:, None]).T @ phi
                        sums[m.number, i] = sums.get((m.number, i), 0.0) + np.concatenate([[loss], gradient, true.ravel(), bound.ravel()])
            for (number, i), cells in sums.items():
                yield pd.DataFrame({"model": number, "point": i, "cell": np.arange(len(cells)), "value": cells})

        sums = self.frame.select("period", "y", "x").mapInPandas(run, "model int, point int, cell int, value double")
        # models x trial points x landmarks^2 numbers
        table = sums.groupBy("model", "point", "cell").agg(F.sum("value").alias("value")).toPandas().sort_values("cell")
        out = {}
        for (number, i), part in table.groupby(["model", "point"]):
            cells, size = part["value"].to_numpy(), len(points[number][i])
            out[number, i] = cells[0], cells[1 : size + 1], *cells[size + 1 :].reshape(2, size, size)
        return out

    def predictions(self, with_train: bool = False) -> DataFrame:
        """Test (and training) predictions of every model: ``keys, period, model, fold, set, truth, response``."""
        models, weights, space, keys = self.models, dict(self.weights), self.space, self.keys

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x, period = np.stack(batch["x"].to_numpy()).astype(float), batch["period"].to_numpy()
                for m in models:
                    test = period == m.fold.test
                    train = (period <= m.fold.train_to) & with_train
                    if m.fold.train_from is not None:
                        train &= period >= m.fold.train_from
                    mine = test | train
                    if mine.any():
                        part = batch.loc[mine, [*keys, "period"]].copy()
                        part["model"], part["fold"] = m.number, m.fold.number
                        part["set"] = np.where(test[mine], "test", "train")
                        part["truth"] = batch.loc[mine, "y"]
                        part["response"] = space.y_mean + space.y_sd * (space.features(x[mine], m) @ weights[m.number])
                        yield part

        schema = ", ".join(f"{k} {self.frame.schema[k].dataType.simpleString()}" for k in keys)
        return self.frame.mapInPandas(run, f"{schema}, period int, model int, fold int, set string, truth double, response double")
