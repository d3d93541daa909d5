"""Origins, folds and candidate tables, generated in place from each series' own length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.operators.reshape import by_period


@dataclass(frozen=True)
class Fold:
    """A test period and the training periods before it."""

    number: int
    train_to: int
    test: int
    train_from: int | None = None


def origins(panel: DataFrame, keys: list[str], cut: int, h: int) -> DataFrame:
    """Training ends per series: the first forecast target is ``cut + 1``, the last the data end."""
    ends = panel.groupBy(*keys).agg(F.max("period").alias("_end"))
    first = F.lit(cut - (h - 1))
    span = F.when(F.col("_end") - h >= first, F.sequence(first, F.col("_end") - h))
    return ends.select(*keys, F.posexplode(span).alias("_i", "training_end")).select(
        *keys,
        (F.col("_i") + 1).cast("int").alias("iteration"),
        F.col("training_end").cast("int").alias("training_end"),
        (F.col("training_end") + 1).cast("int").alias("testing_start"),
        (F.col("training_end") + h).cast("int").alias("last_forecast"),
    )


def fold_rows(frame: DataFrame, keys: list[str], go_back: int, skip: int, gap: int = 0, growing: bool = True) -> DataFrame:
    """Training and test rows of every fold, one test row per fold.

    With n rows the first window has ``n - go_back`` rows and tests follow every ``skip`` rows up
    to n. ``gap`` rows before the test row stay unused. Every row knows its series' length and
    lists its own folds, so no fold table is joined. Output grows with rows times folds, which is
    what raw-row learners need; thin with ``skip``.
    """
    numbered = frame.withColumn("_row", F.row_number().over(by_period(keys))).withColumn(
        "_n", F.count(F.lit(1)).over(W.partitionBy(*keys))
    )
    initial = F.greatest(F.col("_n") - go_back, F.lit(1))
    count = F.floor((F.col("_n") - initial - 1) / skip).cast("int")
    wide = numbered.withColumn("_initial", initial).withColumn("_count", count).filter(F.col("_count") >= 0)

    def role(fold: Column) -> Column:
        test = F.col("_initial") + 1 + fold * skip
        begin = F.lit(1) if growing else test - F.col("_initial")
        return F.when(F.col("_row") == test, F.lit("test")).when(
            (F.col("_row") >= begin) & (F.col("_row") < test - gap), F.lit("train")
        )

    marks = F.transform(F.sequence(F.lit(0), F.col("_count")), lambda f: F.struct((f + 1).cast("int").alias("fold"), role(f).alias("role")))
    exploded = wide.withColumn("_m", F.explode(F.filter(marks, lambda m: m["role"].isNotNull())))
    return exploded.select(*[F.col(c) for c in frame.columns], "_m.fold", "_m.role")


def uniform(key: Column, trial: Column, dimension: int) -> Column:
    """A reproducible number in [0, 1) from integers alone (two linear-congruential steps)."""
    modulus = F.lit(2147483648)
    state = (key * 100_003 + trial * 31 + dimension * 7 + 12345) % modulus
    for _ in range(2):
        state = (state * 1103515245 + 12345) % modulus
    return state / 2147483648.0


def random_candidates(sizes: DataFrame, key: str, id_col: Column, params: dict[str, tuple], trials: int) -> DataFrame:
    """``trials`` draws per series. A parameter is ``(low, high, kind)`` with kind ``int`` (ceiling
    of a uniform draw), ``pow10`` (ten to a uniform power) or ``real``; bounds may be columns."""
    rows = sizes.withColumn("_id", id_col.cast("bigint")).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    out = []
    for i, (name, (low, high, kind)) in enumerate(params.items()):
        low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
        draw = low + uniform(F.col("_id"), F.col("trial").cast("bigint"), i) * (high - low)
        if kind == "int":
            draw = F.ceil(draw).cast("double")
        elif kind == "pow10":
            draw = F.pow(F.lit(10.0), draw)
        out.append(draw.alias(name))
    return rows.select(key, F.col("trial").cast("int").alias("trial"), *out)


def grid_candidates(bounds: DataFrame, key: str, levels: dict[str, int]) -> DataFrame:
    """All combinations of equally spaced levels between ``<name>_lo`` and ``<name>_hi``.

    A combination is a number in mixed radix, so each row of bounds expands by itself.
    """
    total = 1
    for n in levels.values():
        total *= n
    rows = bounds.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    out, radix = [], 1
    for name, n in levels.items():
        step = F.floor(F.col("candidate") / radix) % n
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * step / float(max(n - 1, 1))).alias(name))
        radix *= n
    return rows.select(key, F.col("candidate").cast("int").alias("candidate"), *out)
