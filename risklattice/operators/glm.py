"""Generalised linear fits and isotonic maps whose every step is a sum over the rows.

Only a step's sums reach the driver: one row of about half the square of the number of features. A step is the same in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.functions.scalar import sigmoid

STEPS = 8


@dataclass(frozen=True)
class Fit:
    """A linear predictor with its link."""

    intercept: float
    weights: dict[str, float]
    family: str

    def linear(self) -> Column:
        return sum((F.col(c) * F.lit(w) for c, w in self.weights.items()), F.lit(self.intercept))

    def mean(self) -> Column:
        return sigmoid(self.linear()) if self.family == "logistic" else F.exp(self.linear())


def reweighted_fit(train: DataFrame, features: list[str], label: str, family: str = "logistic", weight: str | None = None, ridge: float = 0.0, steps: int = STEPS) -> Fit:
    """Iteratively reweighted least squares from zero, ``steps`` steps of Newton's method.

    ``family`` is logistic or poisson (log link); ``ridge`` penalises ridge * |weights|^2 / 2 on the mean loss, never the intercept. Each
    step is one aggregate of the Gram matrix and the score vector. Rows with a null feature or label take no part. Raises
    where no row is left or the features are collinear without a penalty.
    """
    if family not in ("logistic", "poisson"):
        raise ValueError(f"unknown family {family!r}")
    rows = train.dropna(subset=[*features, label])
    own, y = F.col(weight) if weight else F.lit(1.0), F.col(label).cast("double")
    size = len(features) + 1
    beta, penalty = np.zeros(size), np.array([0.0] + [ridge] * len(features))
    for _ in range(steps):
        mean = Fit(float(beta[0]), dict(zip(features, map(float, beta[1:]))), family).mean()
        placed = rows.select(own.alias("_w"), (y - mean).alias("_e"), (mean * (1 - mean) if family == "logistic" else mean).alias("_v"), F.lit(1.0).alias("_x0"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features, 1)])
        x = [F.col(f"_x{i}") for i in range(size)]
        gram = [F.sum(F.col("_w") * F.col("_v") * x[i] * x[j]) for i in range(size) for j in range(i, size)]
        found = placed.agg(F.sum("_w"), *[F.sum(F.col("_w") * F.col("_e") * c) for c in x], *gram).first()
        if not found[0]:
            raise ValueError("no rows to fit")
        matrix = np.zeros((size, size))
        matrix[np.triu_indices(size)] = found[1 + size :]
        matrix = matrix + np.triu(matrix, 1).T + np.diag(found[0] * penalty)
        try:
            beta = beta + np.linalg.solve(matrix, np.array(found[1 : 1 + size]) - found[0] * penalty * beta)
        except np.linalg.LinAlgError as e:
            raise ValueError("the features are collinear; drop one or set a penalty") from e
    return Fit(float(beta[0]), dict(zip(features, map(float, beta[1:]))), family)


def stack_by_sums(train: DataFrame, apply_to: DataFrame, bases: dict[str, list[str]], inner: Column, label: str = "y", ridge: float = 1e-3, steps: int = STEPS) -> tuple[DataFrame, dict[str, float]]:
    """A meta-model over the linear parts (log-odds) of base fits on different features: (``apply_to`` with p_<base> and ensemble, weights).

    Bases fit on the rows before the inner block and score it; the meta-model learns from those scores; then bases refit on all
    training rows and the meta-model combines their scores on ``apply_to``.
    """

    def scored(rows: DataFrame, fits: dict[str, Fit]) -> DataFrame:
        return rows.withColumns({f"l_{n}": f.linear() for n, f in fits.items()})

    def fitted(rows: DataFrame) -> dict[str, Fit]:
        return {n: reweighted_fit(rows, own, label, ridge=ridge, steps=steps) for n, own in bases.items()}

    meta = reweighted_fit(scored(train.filter(inner), fitted(train.filter(~inner))), [f"l_{n}" for n in bases], label, ridge=ridge, steps=steps)
    out = scored(apply_to, fitted(train)).withColumn("ensemble", meta.mean()).withColumns({f"p_{n}": sigmoid(F.col(f"l_{n}")) for n in bases})
    return out.drop(*[f"l_{n}" for n in bases]), {n: meta.weights[f"l_{n}"] for n in bases}


def score_cell(score: Column | str, digits: int) -> Column:
    return F.floor((F.col(score) if isinstance(score, str) else score) * 10**digits).cast("long")


def isotonic_cells(df: DataFrame, score: str, label: str, digits: int = 2) -> DataFrame:
    """cell, level: the isotonic map of ``label`` on the score in cells of 10^-digits.

    A cell's level is the largest, over all cells up to it, of the least mean from there to a cell at or after it. Rows shrink to
    cells first, at most 10^digits + 1 for a probability, which bounds their pairs; pooled points never meet on the driver.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    cells = known.groupBy(score_cell(score, digits).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
    every = cells.agg(F.sort_array(F.collect_list(F.struct("cell", "n", "s"))).alias("c"))
    begin = every.select("c", F.posexplode("c").alias("i", "first"))
    spans = begin.select("i", F.posexplode(F.expr("slice(c, i + 1, size(c) - i)")).alias("k", "end"))
    onward = Window.partitionBy("i").orderBy("k")
    summed = spans.select("i", (F.col("i") + F.col("k")).alias("k"), "end.cell", (F.sum("end.s").over(onward) / F.sum("end.n").over(onward)).alias("mean"))
    least = summed.withColumn("least", F.min("mean").over(Window.partitionBy("i").orderBy(F.desc("k"))))
    return least.groupBy("cell").agg(F.max("least").alias("level"))


def calibrated_by(df: DataFrame, score: str, cells: DataFrame, name: str, digits: int = 2) -> DataFrame:
    """Add the level of the last cell at or below the score, or of the first cell for scores below all; null for null scores."""
    own = df.withColumn("_cell", score_cell(score, digits))
    axis = own.select("_cell").distinct().join(cells.select(F.col("cell").alias("_cell"), "level"), "_cell", "full_outer").filter("_cell is not null")
    along = Window.partitionBy(F.lit(0)).orderBy("_cell")  # at most a row a cell
    below = F.last("level", ignorenulls=True).over(along)
    first = F.first("level", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return own.join(axis.select("_cell", F.coalesce(below, first).alias(name)), "_cell", "left").drop("_cell")
