"""Queries on learners, tuning and importance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import rounded
from seriesloom.functions.tails import normal_sf
from seriesloom.operators import arma, baselines, evaluate, factors, folds, forests, joins, ml, systems
from seriesloom.operators.ordering import bind_rows
from seriesloom.operators.windows import growth, lag_frame
from seriesloom.plans import bindings as b
from seriesloom.plans.registry import CUT, query, r6, sql
from seriesloom.plans.reshape import _supply
from seriesloom.sources import literals
from seriesloom.sources.panels import stage

FEATURES = ["y", "orders", "supply", "season"]


def grown(spark, d):
    """Growth per nation of order values, order counts and supplier shipments."""
    panel = b.nation_q(spark, d).join(_supply(spark, d), ["entity", "period"], "left")
    return panel.select(
        "entity", "period", growth("value", ["entity"]).alias("y"), growth("n_orders", ["entity"]).alias("orders"),
        growth("shipped", ["entity"]).alias("supply"), (F.col("period") % 4).cast("double").alias("season"),
    )


def lags(panel, h: int):
    """Rows with lags h and h + 1 of every column of ``grown``, and the features' names."""
    lagged = lag_frame(panel, ["entity"], "y", FEATURES[1:], h, 2)
    names = [c for c in lagged.columns if "_l" in c]
    return ml.pooled_frame(lagged, names, "y", ["entity"], f"lag-frame-{h}"), names


def frame(spark, d, h: int):
    return lags(grown(spark, d), h)


HORIZONS = ((1, "Q"), (4, "Y"))


def _at_horizons(spark, d, work, panel=None):
    """``work(rows, feature names, folds, horizon name, h)`` for both horizons, side by side, on one staged panel."""
    panel = panel or stage(grown(spark, d), "growth-panel")

    def one(horizon):
        h, name = horizon
        return work(*lags(panel, h), _tests(spark, d, h), name, h)

    with ThreadPoolExecutor(len(HORIZONS)) as pool:
        return list(pool.map(one, HORIZONS))


def _records(predictions, model, h, horizon):
    return evaluate.ml_records(predictions, ["entity"], f"{model}_{horizon}_I2", h, horizon)


def _tests(spark, d, h):
    return ml.test_folds(CUT + 1, b.quarters(spark, d)[1], h - 1)


def _both_horizons(spark, d, model, predict):
    """Records of a learner whose ``predict(rows, feature names, folds)`` gives its test forecasts."""
    return bind_rows(*_at_horizons(spark, d, lambda rows, names, at, name, h: _records(predict(rows, names, at), model, h, name)))


def _final_forest(rows, names, at: list[ml.Fold], **how):
    """The study's forest in every fold: its trees and its forecasts."""
    cells, n = forests.binned(rows, ["entity"], min(f.train_to for f in at), "forest-bins")
    size = ml.FINAL_FOREST["node_size"]
    pools = [forests.Pool(f.number, f, ml.FINAL_FOREST["trees"], min(ml.FINAL_FOREST["mtry"], n), size) for f in at]
    trees = forests.grow(cells, n, pools)
    readings = [forests.Reading(p.number, p.number, p.trees, size) for p in pools]
    return trees, forests.predictions(cells, ["entity"], trees, readings, **how)


@query("q_rf_backtest")
def rf_backtest(spark, d):
    """The study's forest at every test period, with bands of one standard error by the infinitesimal jackknife."""
    return _both_horizons(spark, d, "RF", lambda rows, names, at: _final_forest(rows, names, at, errors=True)[1])


def _boosted(rows, at: list[ml.Fold], **how):
    return ml.fit_folds(rows, ["entity"], lambda: ml.boosting(*SHALLOW), at, **how)


# Rounds, depth and rate of the boosting that the queries run (README: times at the study's).
SHALLOW = (20, 3, 0.1)


@query("q_gb_backtest")
def gb_backtest(spark, d):
    return _both_horizons(spark, d, "GB", lambda rows, names, at: _boosted(rows, at).predictions)


def _svr(rows, kernels, costs, epsilons, folds):
    models, number = [], 0
    for kernel in kernels:
        for cost in costs:
            for eps in epsilons:
                for fold in folds:
                    models.append(ml.SvrModel(number, kernel, cost, eps, fold))
                    number += 1
    return ml.KernelRegression(rows, ["entity"], models), models


def _final_svr(rows, at: list[ml.Fold], **how):
    return _svr(rows, ["sigmoid"], [ml.FINAL_SVR["cost"]], [0.1], at)[0].predictions(**how)


@query("q_svr_backtest")
def svr_backtest(spark, d):
    return _both_horizons(spark, d, "SVR", lambda rows, names, at: _final_svr(rows, at))


LEARNERS = ("RF", "GB", "SVR")
ECONOMETRIC = ("RW", "ARIMA", "VAR_LI", "VAR_NK", "FAVAR_FULL", "FAVAR_SW")


_RECORDS: dict[tuple, DataFrame] = {}


def every_record(spark, d):
    """Forecasts of all econometric models and all learners for the same targets, staged once a session."""
    key = spark.sparkContext.applicationId, d
    if key not in _RECORDS:
        _RECORDS[key] = stage(_every_record(spark, d), "all-records")
    return _RECORDS[key]


def _every_record(spark, d):
    panel = stage(grown(spark, d), "growth-panel")
    last = b.quarters(spark, d)[1]
    span = (["entity"], "y")
    made = [
        baselines.baseline_records(panel, *span, CUT, last, models=("RW",)),
        arma.arma_backtest(panel, *span, (2, 1), "ARIMA", CUT, last),
        systems.var_backtest(panel, ["entity"], ["y", "orders"], 1, "VAR_LI", CUT, last),
        systems.var_backtest(panel, ["entity"], ["y", "orders", "supply"], 2, "VAR_NK", CUT, last),
        factors.favar_backtest(panel, *span, ["orders", "supply"], 1, 1, "FAVAR_FULL", CUT, last),
        factors.favar_backtest(panel, *span, ["orders", "supply"], 2, 1, "FAVAR_SW", CUT, last),
    ]

    def learned(rows, names, at, horizon, h):
        found = {"RF": _final_forest(rows, names, at, errors=True)[1], "GB": _boosted(rows, at).predictions, "SVR": _final_svr(rows, at)}
        return bind_rows(*[_records(p, learner, h, horizon) for learner, p in found.items()])

    return bind_rows(*made, *_at_horizons(spark, d, learned, panel))


@query("q_dm_learners")
def dm_learners(spark, d):
    """Each learner against each econometric model, for the quarter and the year: absolute loss, normal p-values."""
    pairs = [(learner, model) for learner in LEARNERS for model in ECONOMETRIC]
    out = evaluate.all_comparisons(every_record(spark, d), ["entity"], [*ECONOMETRIC, *LEARNERS], pairs, 1, False)
    return out.withColumn("p_greater", normal_sf(F.col("statistic")))


@query("q_accuracy_learners")
def accuracy_learners(spark, d):
    """All models side by side, relative to the full FAVAR, in display order."""
    return evaluate.accuracy_table(every_record(spark, d), ["entity"], "FAVAR_FULL", literals.model_order(spark))


@query("q_crisis_learners")
def crisis_learners(spark, d):
    """Forecasts of all models around a recession beside the truth, the forest's bands left out."""
    rows = every_record(spark, d).filter((F.col("horizon") == "Q") & F.col("forecast_period").between(CUT + 2, CUT + 6))
    flagged = joins.regime_join(evaluate.blank_bands(rows, ["RF_Q_I2"]), literals.recessions(spark), "forecast_period")
    return flagged.select("entity", "model_id", "forecast_period", "true_value", "mean", "lower", "upper", "in_regime")


# Random candidates per learner, and the ranges they are drawn from. The study draws 300 of each.
TRIALS = {"RF": 300, "GB": 2, "SVR": 3}
RANGES = {
    "RF": {"trees": (20, 90, "int"), "mtry": (0, 8, "int"), "node_size": (4, 95, "int")},
    "GB": {"trees": (5, 25, "int"), "depth": (1, 4, "int"), "rate": (-1.5, -0.5, "pow10")},
    "SVR": {"cost": (-1.5, 0.5, "pow10"), "epsilon": (0.05, 0.2, "real")},
}


def candidates(spark, learner: str, trials: int) -> list[dict]:
    """Draws of one learner's parameters: ``trials`` rows."""
    seat = spark.range(1).select(F.lit(learner).alias("learner"))
    number = F.lit(sorted(RANGES).index(learner))
    return [r.asDict() for r in folds.random_candidates(seat, "learner", number, RANGES[learner], trials).orderBy("trial").collect()]


def _forest_scores(rows, drawn: list[dict], at: list[ml.Fold]):
    """Test errors of all candidates from one pool of trees per number of features tried and fold."""
    cells, n = forests.binned(rows, ["entity"], min(f.train_to for f in at), "tuning-bins")
    pools, readings = {}, []
    for i, c in enumerate(drawn):
        mtry = min(int(c["mtry"]), n)
        for k, fold in enumerate(at):
            number = mtry * len(at) + k
            held = pools.get(number, forests.Pool(number, fold, 1, mtry, 1 << 62))
            pools[number] = forests.Pool(number, fold, max(held.trees, int(c["trees"])), mtry, min(held.node_size, int(c["node_size"])))
            readings.append(forests.Reading(i * len(at) + k, number, int(c["trees"]), int(c["node_size"])))
    trees = forests.grow(cells, n, list(pools.values()))
    return ml.fold_scores(forests.predictions(cells, ["entity"], trees, readings), ["model", "fold"])


def _scored(rows, learner: str, drawn: list[dict], at: list[ml.Fold]):
    """Test errors of every candidate and fold: ``learner, candidate, fold, rmse``."""
    if learner == "SVR":
        kernels = ("sigmoid", "radial", "polynomial")
        models = [
            ml.SvrModel(i * len(at) + k, kernels[i % 3], c["cost"], c["epsilon"], fold) for i, c in enumerate(drawn) for k, fold in enumerate(at)
        ]
        scores = ml.fold_scores(ml.KernelRegression(rows, ["entity"], models).predictions(), ["model", "fold"])
    elif learner == "RF":
        scores = _forest_scores(rows, drawn, at)
    else:
        out = []
        for i, c in enumerate(drawn):
            fitted = ml.fit_folds(rows, ["entity"], lambda c=c: ml.boosting(c["trees"], c["depth"], c["rate"]), at)
            one = ml.fold_scores(fitted.predictions, ["fold"])
            out.append(one.select(F.lit(learner).alias("learner"), F.lit(i).alias("candidate"), "fold", "rmse"))
        return bind_rows(*out)
    number = F.floor(F.col("model") / len(at)).cast("int")
    return scores.select(F.lit(learner).alias("learner"), number.alias("candidate"), "fold", "rmse")


@query("q_tune")
def tune(spark, d, trials: dict[str, int] = TRIALS):
    """Random search of three learners over the same six growing folds of the training part.

    The winner of each learner is refitted in the folds of the test part; ``outer_rmse`` is its
    mean error there.
    """
    rows, _ = frame(spark, d, 1)
    inner, outer = ml.test_folds(CUT - 5, CUT, 0), _tests(spark, d, 1)
    drawn = {learner: candidates(spark, learner, trials[learner]) for learner in RANGES}
    tried = bind_rows(*[_scored(rows, learner, c, inner) for learner, c in drawn.items()])
    ranked = stage(ml.best_candidate(tried, ["learner"], "candidate"), "tuning-trials")
    best = {r["learner"]: r["candidate"] for r in ranked.filter("is_best").collect()}  # one row a learner
    again = bind_rows(*[_scored(rows, learner, [drawn[learner][k]], outer) for learner, k in best.items()])
    refit = again.groupBy("learner").agg(F.avg("rmse").alias("outer_rmse")).withColumn("is_best", F.lit(True))
    return ranked.join(refit, ["learner", "is_best"], "left")


@query(
    "q_tune_select",
    sql(
        f"""+m AS (SELECT learner, CAST(trees AS INTEGER) AS candidate, avg(rmse) AS s, count(*) AS folds FROM trials GROUP BY 1, 2)
        SELECT learner, candidate, {r6('s')} AS mean_score, folds, row_number() OVER (PARTITION BY learner ORDER BY s, candidate) = 1 AS is_best FROM m""",
        "trials",
    ),
)
def tune_select(spark, d):
    trials = b.trials(spark, d).withColumn("candidate", F.col("trees").cast("int"))
    out = ml.best_candidate(trials, ["learner"], "candidate")
    return out.select("learner", "candidate", rounded(F.col("mean_score")).alias("mean_score"), "folds", "is_best")


@query("q_benchmark")
def benchmark(spark, d):
    """Three learners on the same folds: RMSE and median absolute error of test and training rows."""
    rows, names = frame(spark, d, 1)
    at = _tests(spark, d, 1)
    rf = _final_forest(rows, names, at, with_train=True)[1].drop("model", "se")
    gb = _boosted(rows, at, with_train=True).predictions
    svr = _final_svr(rows, at, with_train=True).drop("model")
    every = rf.withColumn("learner", F.lit("RF")).unionByName(gb.withColumn("learner", F.lit("GB"))).unionByName(svr.withColumn("learner", F.lit("SVR")))
    errors = every.withColumn("error", F.col("truth") - F.col("response")).withColumn("rel_error", F.lit(None).cast("double"))
    tagged = stage(errors, "benchmark-predictions")  # the measures pass over it several times
    scored = evaluate.error_metrics(tagged, ["learner", "set"])
    return scored.select("learner", "set", "n", "rmse", "mdae")


@query("q_importance")
def importance(spark, d):
    """Mean impurity importance over fold models per learner and horizon, rescaled, top ten with ties."""
    words = {"Q": "1-quarter ahead", "Y": "1-year ahead"}

    def gains_of(rows, names, at, name, _):
        forest = _final_forest(rows, names, at)[0].importance()
        out = [("RF", words[name], names[i], fold, float(g)) for fold, gains in forest.items() for i, g in enumerate(gains)]
        return out + [("GB", words[name], names[i], fold, g) for fold, i, g in _boosted(rows, at).importance]

    table = [row for rows in _at_horizons(spark, d, gains_of) for row in rows]  # folds x features rows
    gains = spark.createDataFrame(table, "learner string, horizon string, feature string, fold int, gain double")
    return ml.importance_rank(gains, ["learner", "horizon"], "feature", "gain")


@query(
    "q_importance_rank",
    sql(
        f"""WITH m AS (SELECT l_returnflag AS horizon, l_suppkey AS feature, avg(l_extendedprice) AS importance FROM lineitem GROUP BY 1, 2),
        s AS (SELECT *, (importance - min(importance) OVER p)/(max(importance) OVER p - min(importance) OVER p) AS rescaled,
                     rank() OVER (PARTITION BY horizon ORDER BY importance DESC) AS r FROM m WINDOW p AS (PARTITION BY horizon))
        SELECT horizon, feature, {r6('importance')} AS importance, {r6('rescaled')} AS rescaled FROM s WHERE r <= 10""",
    ),
)
def importance_rank(spark, d):
    rows = b.table(spark, d, "lineitem").selectExpr("l_returnflag AS horizon", "l_suppkey AS feature", "l_extendedprice AS gain")
    out = ml.importance_rank(rows, ["horizon"], "feature", "gain")
    return out.select("horizon", "feature", rounded(F.col("importance")).alias("importance"), rounded(F.col("rescaled")).alias("rescaled"))
