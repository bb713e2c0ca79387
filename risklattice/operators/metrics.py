"""Exact measures of rare-event rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklattice.functions.scalar import clip, ratio
from risklattice.operators.ranking import cell_quantiles, ordered_numbers, running_totals, score_cells, top_k


def _confusion_cells(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    sums = {"tp": F.sum(F.col(label).cast("long")), "n": F.count(F.lit(1))}
    cells = score_cells(df.filter(F.col(label).isNotNull()), keys, score, sums)
    return running_totals(cells, keys, ["tp", "n"])


def long_scores(df: DataFrame, models: list[str], keep: list[str], score: str = "score") -> DataFrame:
    """One row per model and observation."""
    return df.unpivot(keep, models, "model", score)


def ranking_quality(df: DataFrame, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Base rate, average precision and ROC AUC per group, ties handled exactly, in one pass.

    Average precision steps over distinct scores, with no interpolation. AUC gives half credit to ties.
    """
    cells = _confusion_cells(df, keys, score, label)
    fp, cum_fp = F.col("n") - F.col("tp"), F.col("cum_n") - F.col("cum_tp")
    pos, neg = F.sum("tp").cast("double"), F.sum(fp).cast("double")
    gained = F.sum(F.col("tp") * ratio(F.col("cum_tp"), F.col("cum_n")))
    below = F.sum(F.col("tp").cast("double") * (fp.cast("double") / 2 - cum_fp.cast("double"))) + pos * neg
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.sum("tp").alias("positives"),
        ratio(pos, F.sum("n")).alias("base_rate"),
        F.try_divide(gained, pos).alias("average_precision"),
        F.try_divide(below, pos * neg).alias("roc_auc"),
    )


def roc_points(df: DataFrame, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, highest first."""
    cells = _confusion_cells(df, keys, score, label)
    return cells.select(
        *keys,
        F.col("score").alias("threshold"),
        ratio(F.col("cum_tp"), F.col("all_tp")).alias("tpr"),
        ratio(F.col("cum_n") - F.col("cum_tp"), F.col("all_n") - F.col("all_tp")).alias("fpr"),
    )


def brier(score: Column, label: Column) -> Column:
    """Mean squared error of a probability clipped to [0, 1]; an aggregate."""
    return F.avg(F.pow(label.cast("double") - clip(score, 0.0, 1.0), F.lit(2.0)))


def hits_at_k(df: DataFrame, keys: list[str], k: int, week: str = "week", area: str = "area", score: str = "score", label: str = "y") -> DataFrame:
    """Events caught by the weekly top k and all events, per group.

    Two narrow passes: the ranked one keeps only k rows per week and task before its shuffle, so the
    full score table is never moved.
    """
    if not keys:
        return hits_at_k(df.withColumn("_all", F.lit(0)), ["_all"], k, week, area, score, label).drop("_all")
    best = top_k(df.filter(F.col(score).isNotNull()), keys + [week], [F.col(score).desc(), F.col(area).asc()], k)
    hits = best.groupBy(*keys).agg(F.sum(F.col(label).cast("long")).alias("hits"), F.count(F.lit(1)).alias("flagged"))
    everything = df.groupBy(*keys).agg(
        F.sum(F.col(label).cast("long")).alias("positives"), F.count(F.lit(1)).alias("rows"),
        F.countDistinct(area).alias("areas"),
    )
    return everything.join(hits, keys, "left")


def recall_at_k(df: DataFrame, keys: list[str], k: int, areas: int | None = None, **cols) -> DataFrame:
    """Micro-averaged recall in the weekly top k and its lift over a random list.

    A week without an event adds nothing to either sum, so leaving it out needs no filter.
    """
    caught = hits_at_k(df, keys, k, **cols)
    recall = ratio(F.col("hits"), F.col("positives"))
    n = F.lit(areas) if areas is not None else F.col("areas")
    return caught.select(*keys, "hits", "positives", recall.alias("recall_at_k"), (recall / (F.lit(float(k)) / n)).alias("lift_at_k"))


def confusion_at_k(df: DataFrame, keys: list[str], k: int, **cols) -> DataFrame:
    """Confusion counts, precision and recall of the weekly top k."""
    h = hits_at_k(df, keys, k, **cols)
    return h.select(
        *keys,
        F.col("hits").alias("tp"),
        (F.col("flagged") - F.col("hits")).alias("fp"),
        (F.col("positives") - F.col("hits")).alias("fn"),
        (F.col("rows") - F.col("flagged") - F.col("positives") + F.col("hits")).alias("tn"),
        ratio(F.col("hits"), F.col("flagged")).alias("precision"),
        ratio(F.col("hits"), F.col("positives")).alias("recall"),
    )


def weekly_flag(df: DataFrame, k: int, week: str = "week", area: str = "area", score: str = "score", keys: list[str] = []) -> DataFrame:
    """Weekly rank, first key first among ties, with a flag on the top k; a week's areas are numbered over all tasks."""
    ranked = ordered_numbers(df.withColumn("_down", -F.col(score)), keys + [week], ["_down", area], "rank").drop("_down")
    return ranked.withColumn("flagged", F.col("rank") <= k)


def calibration(df: DataFrame, keys: list[str], bins: int = 10, score: str = "score", label: str = "y") -> DataFrame:
    """Mean predicted against observed in quantile bins of the score.

    Ties stay together and repeated edges merge, so there may be fewer bins. Edges are one array per
    group.
    """
    if not keys:
        return calibration(df.withColumn("_all", F.lit(0)), ["_all"], bins, score, label).drop("_all")
    sums = {"tp": F.sum(F.col(label).cast("long")), "n": F.count(F.lit(1))}
    cells = running_totals(score_cells(df, keys, score, sums), keys, ["n"], descending=False)
    edges = cell_quantiles(cells, keys, [i / bins for i in range(bins + 1)])
    inner = F.slice(F.array_distinct("edges"), 2, bins)
    binned = cells.join(edges, keys).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("score"))))
    return binned.groupBy(*keys, "bin").agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("predicted"),
        ratio(F.sum("tp"), F.sum("n")).alias("observed"),
    )


def catch_comparison(df: DataFrame, models: list[str], k: int, baseline: str, week: str = "week", area: str = "area", label: str = "y") -> DataFrame:
    """Events caught in the weekly top k by each ranker and the difference to one of them."""
    tall = long_scores(df, models, [week, area, label])
    caught = hits_at_k(tall, ["model"], k, week=week, area=area, label=label).select("model", "hits", "positives")
    base = caught.filter(F.col("model") == baseline).select("hits").scalar()
    return caught.withColumn("extra", F.col("hits") - base)


def macro_average(fold_metrics: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Plain mean over folds; a metric missing in a fold is left out."""
    return fold_metrics.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("folds"))


def severity_error(df: DataFrame, truth: str, predicted: str, constant: float = 1.0) -> DataFrame:
    """Mean absolute error of a severity model against a constant guess."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(truth).alias("mean_observed"),
        F.avg(predicted).alias("mean_predicted"),
        F.avg(F.abs(F.col(truth) - F.col(predicted))).alias("mae_model"),
        F.avg(F.abs(F.col(truth) - F.lit(constant))).alias("mae_constant"),
    )


def head_to_head(fold_metrics: DataFrame, metric: str, challenger: str, holder: str, fold: str = "fold", model: str = "model") -> DataFrame:
    """Wins, losses and margins of one model over another across folds."""
    wide = fold_metrics.groupBy(fold).pivot(model, [challenger, holder]).agg(F.first(metric))
    gap = F.col(challenger) - F.col(holder)
    return wide.agg(
        F.count_if(gap > 0).alias("wins"), F.count_if(gap < 0).alias("losses"),
        F.min(gap).alias("smallest_margin"), F.max(gap).alias("largest_margin"),
    )


def range_within(fold_metrics: DataFrame, fold: str, metric: str, model: str = "model") -> DataFrame:
    """Spread of the models inside each fold, and the best of them; equal ones by name."""
    best = F.max_by(model, F.struct(F.col(metric), F.col(model))).alias("best")
    return fold_metrics.groupBy(fold).agg((F.max(metric) - F.min(metric)).alias("range_in_fold"), best)


def metric_ranges(fold_metrics: DataFrame, metric: str, fold: str = "fold", model: str = "model") -> DataFrame:
    """Spread of each model over folds, and the model that is best most often."""
    best = fold_metrics.groupBy(fold).agg(F.max_by(model, F.struct(F.col(metric), F.col(model))).alias("best"))
    wins = best.groupBy(F.col("best").alias(model)).agg(F.count(F.lit(1)).alias("folds_led"))
    spread = fold_metrics.groupBy(model).agg((F.max(metric) - F.min(metric)).alias("range_over_folds"))
    return spread.join(wins, model, "left").na.fill(0, ["folds_led"])
