"""Rare-event models on Spark ML: scaling, calibration, stacking, recalibration and drivers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.functions.scalar import clip, log_odds, sigmoid
from risklattice.operators.metrics import ranking_quality, recall_at_k
from risklattice.operators.panel import complete_horizon, forward_label
from risklattice.operators.ranking import ordered_numbers
from risklattice.session import cut_lineage

SPLITS = 3
SMALLEST_SPLIT = 50

# Features reported as one driver because their separate weights mean nothing.
DRIVER_FAMILY = {
    "own_events_cum": "history", "own_rate_longrun": "history", "own_ever": "history",
    "cal_sin": "season", "cal_cos": "season",
}


@dataclass
class Scaler:
    """Mean and population deviation of the training rows; a constant column scales to zero."""

    features: list[str]
    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, features: list[str]) -> "Scaler":
        return cls.with_sums(train, features, {})[0]

    @classmethod
    def with_sums(cls, train: DataFrame, features: list[str], sums: dict[str, Column]) -> tuple["Scaler", dict[str, float]]:
        """The scaler and further sums over the same rows, from one aggregate: one row of 2 x features numbers and a few more."""
        row = train.agg(F.count(F.lit(1)), *[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features], *[c.alias(n) for n, c in sums.items()]).first()
        scaler = cls(features, {c: float(row[f"m_{c}"] or 0) for c in features}, {c: float(row[f"s_{c}"] or 0) for c in features})
        return scaler, {n: float(row[n] or 0) for n in sums}

    def column(self, c: str) -> Column:
        if self.std[c] == 0:
            return F.lit(0.0)
        return (F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"z_{c}": self.column(c) for c in self.features})


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (2 n_c) per class, so that both classes weigh the same."""
    share = df.select(F.avg(F.col(label).cast("double"))).scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (F.lit(1.0) - share)))


def dense_code(keys: DataFrame, key: str, name: str = "code") -> DataFrame:
    """Integer code from 0 by key order, numbered over all tasks."""
    placed = ordered_numbers(keys.select(key).distinct(), [], [key], "_place")
    return placed.select(key, (F.col("_place") - 1).cast("int").alias(name))


def area_split(df: DataFrame, area: str = "area", splits: int = SPLITS, name: str = "split") -> DataFrame:
    """Calibration split by area: an area's rows are never in both the fitted and the calibrated part."""
    codes = dense_code(df, area, "_code").withColumn(name, F.col("_code") % splits).drop("_code")
    return df.join(codes, area)


def _probability(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


@dataclass
class Learner:
    """A Spark ML classifier on scaled or raw features.

    With ``balanced`` both classes weigh the same in each fit, counted on the very rows of that fit; row weights multiply. Where those
    rows hold one class only, nothing can be weighed against it: the fit is ``only``, that class's probability, with all weights zero.
    """

    features: list[str]
    label: str = "y"
    kind: str = "logistic"
    weight: str | None = None
    params: dict = field(default_factory=dict)
    balanced: bool = False
    scaler: Scaler | None = None
    model: PipelineModel | None = None
    only: float | None = None

    def fit(self, train: DataFrame) -> "Learner":
        scaled = self.kind == "logistic"
        fitted = Learner(self.features, self.label, self.kind, self.weight, self.params, self.balanced)
        y, own = F.col(self.label).cast("double"), F.col(self.weight) if self.weight else F.lit(1.0)
        sums = {"_share": F.avg(y), "_positive": F.sum(own * y), "_all": F.sum(own), "_rows": F.count(y)}
        # Means, deviations, class shares and weights come from one pass.
        fitted.scaler, found = Scaler.with_sums(train, self.features if scaled else [], sums)
        mass, weight = found["_all"], self.weight
        if self.balanced:
            share = found["_share"]
            if not found["_rows"]:
                raise ValueError("no rows to fit")
            if not 0 < share < 1:
                fitted.only = share
                return fitted
            mass = found["_positive"] * 0.5 / share + (found["_all"] - found["_positive"]) * 0.5 / (1 - share)
            train, weight = train.withColumn("_mass", own * F.when(y > 0, 0.5 / share).otherwise(0.5 / (1 - share))), "_mass"
        train = fitted.scaler.apply(train)
        if not scaled:
            fitted.scaler = None
        columns = [f"z_{c}" for c in self.features] if scaled else self.features
        fitted.model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_features"), self._stage(weight, mass)]).fit(train)
        return fitted

    def _stage(self, weight: str | None, mass: float):
        common = {"featuresCol": "_features", "labelCol": self.label}
        if weight:
            common["weightCol"] = weight
        if self.kind == "logistic":
            c = self.params.get("C", 1.0)
            return LogisticRegression(maxIter=self.params.get("maxIter", 2000), regParam=1.0 / (c * float(mass)), standardization=False, tol=1e-6, **common)
        if self.kind == "forest":
            given = {"numTrees": 300, "maxDepth": 14, "minInstancesPerNode": 20, "seed": 7} | self.params
            return RandomForestClassifier(**given, **common)
        if self.kind == "boosting":
            given = {"maxIter": 400, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 7} | self.params
            return GBTClassifier(**given, **common)
        raise ValueError(f"unknown learner {self.kind!r}")

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        if self.only is not None:
            return df.withColumn(name, F.lit(self.only))
        if self.scaler:
            # A linear model is one expression over the columns: it stays inside generated code.
            return df.withColumn(name, sigmoid(self.linear_part()))
        return _probability(self.model.transform(df), name).select(*df.columns, name)

    def linear_part(self) -> Column:
        weights = self.coefficients()
        return sum((self.scaler.column(c) * F.lit(w) for c, w in weights.items()), F.lit(self.intercept()))

    def coefficients(self) -> dict[str, float]:
        if self.only is not None:
            return dict.fromkeys(self.features, 0.0)
        return dict(zip(self.features, (float(v) for v in self.model.stages[-1].coefficients)))

    def intercept(self) -> float:
        if self.only is not None:
            return float("inf") if self.only > 0 else float("-inf")
        return float(self.model.stages[-1].intercept)


@dataclass
class Ranker:
    """A column taken as the score: a baseline that goes through the same protocols as a fitted learner."""

    column: str
    label: str = "y"
    weight: str | None = None

    def fit(self, train: DataFrame) -> "Ranker":
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, F.col(self.column).cast("double"))


@dataclass
class Calibrated:
    """Average of isotonic-calibrated fits, each calibrated on rows held out of it."""

    parts: list[tuple[Learner, object]]

    @classmethod
    def fit(cls, learner: Learner, train: DataFrame, split: str = "split", splits: int = SPLITS, smallest: int = SMALLEST_SPLIT, masks: list[tuple[Column, Column]] | None = None) -> "Calibrated":
        """Rows with value i of the integer column ``split`` are held out of the i-th fit, or else ``masks`` give pairs (fitted, held out).

        Fewer than ``smallest`` rows in a part are too few for an isotonic map: this raises, and the caller fits the plain learner instead.
        """
        masks = masks or [(F.col(split) != i, F.col(split) == i) for i in range(splits)]
        sizes = train.agg(*[F.least(F.count_if(a), F.count_if(b)) for a, b in masks]).first()
        if min(sizes) < smallest:
            raise ValueError(f"a calibration part has {min(sizes)} rows, fewer than {smallest}; fit the learner without calibration")

        def one(i: int):
            fitted = learner.fit(train.filter(masks[i][0]))
            held = fitted.score(train.filter(masks[i][1]), "_raw")
            iso = IsotonicRegression(featuresCol="_raw", labelCol=learner.label, predictionCol="_cal", **({"weightCol": learner.weight} if learner.weight else {}))
            return fitted, iso.fit(held)

        # Independent fits: submitted together, scheduled by Spark.
        with ThreadPoolExecutor(len(masks)) as pool:
            return cls(list(pool.map(one, range(len(masks)))))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        keep, cal = df.columns, []
        for i, (learner, iso) in enumerate(self.parts):
            df = iso.setPredictionCol(f"_c{i}").setFeaturesCol(f"_r{i}").transform(learner.score(df, f"_r{i}"))
            cal.append(F.col(f"_c{i}"))
        mean = sum(cal[1:], cal[0]) / F.lit(float(len(cal)))
        return df.select(*keep, mean.alias(name))


def poisson_stage(train: DataFrame, features: list[str], count: str = "events", alpha: float = 1.0, smallest: int = SMALLEST_SPLIT):
    """Second stage of the hurdle: Poisson on (count - 1) of the positive rows, with penalty alpha |w|^2 / 2 on the mean loss.

    Raises where fewer than ``smallest`` rows are positive, or where none holds more than one event: there is then nothing to fit.
    """
    positive = train.filter(F.col(count) > 0).withColumn("_extra", F.col(count) - 1)
    scaler, found = Scaler.with_sums(positive, features, {"rows": F.count(F.lit(1)), "extra": F.sum("_extra")})
    if found["rows"] < smallest or found["extra"] <= 0:
        raise ValueError(f"{found['rows']:.0f} positive rows with {found['extra']:.0f} further events are too few for the second stage")
    # Reweighted least squares divides by the sum of fitted means, which at the optimum is the sum of the labels.
    reg = alpha * found["rows"] / found["extra"]
    used = [c for c in features if scaler.std[c] > 0]
    stages = [
        VectorAssembler(inputCols=[f"z_{c}" for c in used], outputCol="_features2"),
        GeneralizedLinearRegression(featuresCol="_features2", labelCol="_extra", predictionCol="_mu", family="poisson", link="log", regParam=reg, maxIter=50),
    ]
    return scaler, used, Pipeline(stages=stages).fit(scaler.apply(positive))


def severity(df: DataFrame, stage, probability: str = "score") -> DataFrame:
    """Events expected given any, and expected at all (probability x severity)."""
    scaler, used, model = stage
    fitted = model.stages[-1]
    linear = sum((scaler.column(c) * F.lit(float(w)) for c, w in zip(used, fitted.coefficients)), F.lit(float(fitted.intercept)))
    given = F.lit(1.0) + F.greatest(F.exp(linear), F.lit(0.0))
    return df.select(*df.columns, given.alias("severity"), (F.col(probability) * given).alias("expected"))


META = {"ensemble": True, "ensemble_unweighted": False}  # the two meta-models: with and without balanced classes


def stack(train: DataFrame, apply_to: DataFrame, bases: dict, inner: Column, calibrated: tuple[str, ...] = (), split: str = "split", label: str = "y"):
    """Two meta-models over the log-odds of base learners, one balanced and one not.

    Bases fit before the inner block score it, and the meta-models learn from those scores; bases fit on all
    training rows and the meta-models combine their scores on ``apply_to``. Bases named in ``calibrated`` are calibrated by
    the column ``split``. Returns (scored, weights), weights a table (meta, base, weight, intercept).
    """

    def fit(name, rows):
        learner = bases[name]
        return Calibrated.fit(learner, rows, split) if name in calibrated else learner.fit(rows)

    def score_all(models, rows):
        for n, m in models.items():
            rows = m.score(rows, f"p_{n}")
        return rows.withColumns({f"l_{n}": log_odds(f"p_{n}") for n in models})

    # Both fits of every base need nothing of each other: all are submitted together, the longest first, and share the written rows.
    jobs = [(n, rows) for n in sorted(bases, key=lambda n: bases[n].kind != "boosting") for rows in (train, train.filter(~inner))]
    with ThreadPoolExecutor(len(jobs)) as pool:
        fitted = list(pool.map(lambda job: fit(*job), jobs))
    final, first = ({n: m for (n, _), m in list(zip(jobs, fitted))[k::2]} for k in (0, 1))
    final, first = {n: final[n] for n in bases}, {n: first[n] for n in bases}
    block = cut_lineage(score_all(first, train.filter(inner)))
    metas = {name: Learner([f"l_{n}" for n in bases], label, balanced=balanced).fit(block) for name, balanced in META.items()}
    scored = cut_lineage(score_all(final, apply_to))
    for name, meta in metas.items():
        scored = meta.score(scored, name)
    rows = [(name, n, float(w), float(meta.intercept())) for name, meta in metas.items() for n, w in zip(bases, meta.coefficients().values())]
    weights = train.sparkSession.createDataFrame(rows, "meta string, base string, weight double, intercept double")
    return scored.drop(*[f"l_{n}" for n in bases]), weights


def recalibrate(df: DataFrame, probability: str, targets: DataFrame, group: str, bracket: float = 12.0, passes: int = 6, grid: int = 32, to_end: bool = False) -> DataFrame:
    """Shift each group's log-odds so that its mean probability meets its target; order is kept.

    ``targets`` has (group, target). Every pass evaluates a grid of shifts in one aggregate over distinct
    probabilities, then narrows the bracket around the crossing. Where the target lies beyond the bracket the
    input stays and the shift is null, or with ``to_end`` the shift is the bracket's nearer end, as bisection gives it. Groups are few (horizons).
    """
    odds = log_odds(F.col("_p"), 1e-9)
    cells = cut_lineage(df.groupBy(group, F.col(probability).alias("_p")).agg(F.count(F.lit(1)).alias("_n")))
    bounds = targets.select(group, "target", F.lit(-bracket).alias("_lo"), F.lit(bracket).alias("_hi"), F.lit(True).alias("_ok"))
    for i in range(passes):
        width = (F.col("_hi") - F.col("_lo")) / F.lit(float(grid))
        joined = cells.join(bounds, group)
        means = [
            (F.sum(F.col("_n") * sigmoid(odds + F.col("_lo") + width * k)) / F.sum("_n")).alias(f"_m{k}") for k in range(grid + 1)
        ]
        got = joined.groupBy(group).agg(F.first("target").alias("target"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_ok").alias("_ok"), *means)
        below = F.size(F.filter(F.array(*[F.col(f"_m{k}") for k in range(grid + 1)]), lambda m: m <= F.col("target")))
        at = F.greatest(F.least(below - 1, F.lit(grid - 1)), F.lit(0))
        reach = F.lit(True) if to_end else (F.col("_m0") <= F.col("target")) & (F.col("target") <= F.col(f"_m{grid}")) if i == 0 else F.col("_ok")
        bounds = got.select(group, "target", reach.alias("_ok"), (F.col("_lo") + width * at).alias("_lo2"), (F.col("_lo") + width * (at + 1)).alias("_hi2")).withColumnsRenamed({"_lo2": "_lo", "_hi2": "_hi"})
    shift = bounds.select(group, "target", F.when(F.col("_ok"), (F.col("_lo") + F.col("_hi")) / 2).alias("shift"))
    moved = sigmoid(log_odds(F.col(probability), 1e-9) + F.col("shift"))
    return df.join(shift, group).withColumn("recalibrated", F.coalesce(moved, F.col(probability)))


def contributions(df: DataFrame, keys: list[str], scaler: Scaler, weights: dict[str, float], families: dict[str, str] = DRIVER_FAMILY) -> DataFrame:
    """Long table (keys, feature, value, contribution): coefficient times standardised value, exactly additive."""
    parts = [
        F.struct(F.lit(families.get(c, c)).alias("family"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), (scaler.column(c) * F.lit(weights[c])).alias("contribution"))
        for c in scaler.features
    ]
    return df.select(*keys, F.explode(F.array(*parts)).alias("d")).select(*keys, "d.*")


def top_drivers(long: DataFrame, keys: list[str], top: int = 6) -> DataFrame:
    """Largest absolute family contributions per entity, equal ones (to 9 places) by name; a value only where the family has one member."""
    sums = long.groupBy(*keys, "family").agg(
        F.sum("contribution").alias("contribution"), F.count(F.lit(1)).alias("n_features"), F.first("value").alias("_v")
    ).withColumn("value", F.when(F.col("n_features") == 1, F.col("_v"))).drop("_v")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round(F.abs("contribution"), 9).desc(), "family"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= top)


def collinear_pair(long: DataFrame, keys: list[str], left: str, right: str, top: int = 6) -> DataFrame:
    """How often two features both rank in the top and oppose each other, with mean size and mean net."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round(F.abs("contribution"), 9).desc(), "feature"))
    ranked = long.withColumn("rank", rank).filter(F.col("feature").isin(left, right))
    side = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    wide = ranked.groupBy(*keys).agg(side(left, "contribution").alias("a"), side(right, "contribution").alias("b"), F.max("rank").alias("worst"))
    both = (F.col("worst") <= top) & (F.signum("a") * F.signum("b") < 0)
    return wide.agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(both).alias("opposed"),
        F.avg(F.when(both, (F.abs("a") + F.abs("b")) / 2)).alias("mean_size"), F.avg(F.when(both, F.col("a") + F.col("b"))).alias("mean_net"),
    )


def evaluate(scored: DataFrame, keys: list[str], k: int = 20, score: str = "score", label: str = "y") -> DataFrame:
    """Ranking quality, recall at k and Brier score per group."""
    quality = ranking_quality(scored, keys, score, label)
    caught = recall_at_k(scored, keys, k, score=score, label=label).select(*keys, "recall_at_k", "lift_at_k")
    squared = F.pow(F.col(label).cast("double") - clip(F.col(score), 0.0, 1.0), F.lit(2.0))
    loss = scored.groupBy(*keys).agg(F.avg(squared).alias("brier"))
    return quality.join(caught, keys).join(loss, keys)


def rolling_origin(panel: DataFrame, learner: Learner, folds: int, test_weeks: int, last_step: int, calibrate: bool = True, step: str = "t", area: str = "area", keep: tuple[str, ...] = ()) -> DataFrame:
    """Out-of-sample scores for every test block, each from a model fitted on the weeks before it."""
    rows = area_split(panel, area) if calibrate else panel
    blocks = []
    for i in range(folds):
        start = last_step + 1 - (folds - i) * test_weeks
        if start > 0:
            blocks.append((i + 1, start))

    def one(block):
        fold, start = block
        train = rows.filter(F.col(step) < start)
        test = rows.filter((F.col(step) >= start) & (F.col(step) < start + test_weeks))
        model = Calibrated.fit(learner, train) if calibrate else learner.fit(train)
        return model.score(test).select(area, "week", step, learner.label, "score", *keep).withColumn("fold", F.lit(fold))

    with ThreadPoolExecutor(min(4, max(1, len(blocks)))) as pool:
        parts = list(pool.map(one, blocks))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut_lineage(out)  # every metric reads the scores again


def horizon_experiment(panel: DataFrame, horizons: list[int], learner: Learner | Ranker, folds: int, test_weeks: int, last_step: int, k: int = 20, events: str = "events", calibrate: bool = True) -> DataFrame:
    """Same model and protocol for several forecast horizons (in weeks)."""
    parts = []
    for h in horizons:
        labelled = complete_horizon(panel.withColumn("y", forward_label(events, h)), h, F.lit(last_step))
        scores = rolling_origin(cut_lineage(labelled), learner, folds, test_weeks, last_step - (h - 1), calibrate)
        parts.append(evaluate(scores, ["fold"], k).withColumn("horizon_days", F.lit(7 * h)))
    return _stacked(parts)


def delay_experiment(build, delays: list[int], learner: Learner | Ranker, folds: int, test_weeks: int, last_step: int, k: int = 20, calibrate: bool = True) -> DataFrame:
    """Same model on features rebuilt with further weeks withheld; ``build(delay)`` returns a labelled panel."""
    return _stacked([
        evaluate(rolling_origin(build(d), learner, folds, test_weeks, last_step, calibrate), ["fold"], k).withColumn("delay_weeks", F.lit(d)) for d in delays
    ])


def under_reporting_experiment(panel: DataFrame, weights: DataFrame, learner: Learner, folds: int, test_weeks: int, last_step: int, k: int = 20, area: str = "area") -> DataFrame:
    """Model with and without inverse-detection weights per area (columns area, weight)."""
    from dataclasses import replace

    weighted = cut_lineage(panel.join(weights.select(area, "weight"), area))
    return _stacked([
        evaluate(rolling_origin(weighted, replace(learner, weight=w), folds, test_weeks, last_step), ["fold"], k).withColumn("weighting", F.lit(name))
        for name, w in (("none", None), ("inverse detection", "weight"))
    ])


def row_order_splits(train: DataFrame, order: list[str], label: str = "y", splits: int = SPLITS, name: str = "split") -> DataFrame:
    """Contiguous parts of each class in the given row order, as an unshuffled stratified split deals them."""
    placed = ordered_numbers(train, [label], order, "_place")
    sizes = train.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    return placed.join(sizes, label).withColumn(name, F.floor((F.col("_place") - 1) * splits / F.col("_rows")).cast("int")).drop("_place", "_rows")


def expanding_masks(last: int, first: int, splits: int = SPLITS, step: str = "t") -> list[tuple[Column, Column]]:
    """Time splits on whole weeks: the i-th part is fitted on all weeks before a block and calibrated on the block."""
    size = (last + 1 - first) // (splits + 1)
    starts = [last + 1 - (splits - i) * size for i in range(splits)]
    return [(F.col(step) < s, (F.col(step) >= s) & (F.col(step) < s + size)) for s in starts]


def calibration_schemes(train: DataFrame, test: DataFrame, learner: Learner, k: int = 20, area: str = "area", step: str = "t") -> DataFrame:
    """The same learner without calibration and with four ways to hold out calibration rows, compared on one test block."""
    low, high = train.agg(F.min(step), F.max(step)).first()
    schemes = {
        "none": lambda: learner.fit(train),
        "rows by area": lambda: Calibrated.fit(learner, cut_lineage(row_order_splits(train, [area, step], learner.label))),
        "rows by week": lambda: Calibrated.fit(learner, cut_lineage(row_order_splits(train, [step, area], learner.label))),
        "expanding time": lambda: Calibrated.fit(learner, train, masks=expanding_masks(high, low, step=step)),
        "explicit by area": lambda: Calibrated.fit(learner, cut_lineage(area_split(train, area))),
    }
    parts = []
    for name, fit in schemes.items():
        model = fit()
        parts.append(evaluate(cut_lineage(model.score(test).withColumn("scheme", F.lit(name))), ["scheme"], k))
    return _stacked(parts)


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
