"""Validation of the concentration models on rows they were not fitted on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflux import dims
from segflux.operators import forest, groups, regression, reshape

LINE_PREDICTORS = dims.STEPWISE_ROUNDS[-1]
ALL = "all"


def linear_model(rows: DataFrame, key: str = "row_id", response: str = "lnco2", predictors: Sequence[str] = LINE_PREDICTORS):
    """Least squares on the training quarters of the rows."""
    train = rows.filter(forest.is_training(F.col(key)))
    return regression.fit(regression.factor(train, response, predictors), predictors)


def held_out(rows: DataFrame, key: str = "row_id") -> DataFrame:
    return rows.filter(~forest.is_training(F.col(key)))


def predictions(
    rows: DataFrame, line: regression.Fit, trees: forest.Forest | None, keep: Sequence[str], response: str = "lnco2"
) -> DataFrame:
    """``keep`` with pred_lm and res_lm and, with a forest, pred_rf and res_rf: prediction minus truth.

    Rows that lack a predictor stay, with a NULL for the model that needs it.
    """
    out = regression.with_prediction(rows, line, "pred_lm", "res_lm")
    if trees is None:
        return out.select(*keep, "pred_lm", "res_lm")
    names = list(dict.fromkeys([*keep, response, "pred_lm", "res_lm"]))
    out = forest.score(trees, out, trees.predictors, names, "pred_rf", keep_incomplete=True)
    return out.withColumn("res_rf", F.col("pred_rf") - F.col(response)).select(*keep, "pred_lm", "res_lm", "pred_rf", "res_rf")


def accuracy(predicted: DataFrame, models: Sequence[str] = ("lm", "rf"), response: str = "lnco2", month: str = "mon") -> DataFrame:
    """Per month and over all rows, for each model: r-squared in log and original space, error, residuals.

    Months and the total come from one pass (grouping sets).  ``rmse`` is halved inside, as published, and
    counts every row of the month; the others take the rows with a prediction.
    """
    truth = F.col(response)
    cells = []
    for m in models:
        pred, res = F.col(f"pred_{m}"), F.col(f"res_{m}")
        cells += [
            F.count(pred).alias(f"n_{m}"),
            F.regr_r2(truth, pred).alias(f"r2_{m}"),
            F.regr_r2(F.exp(truth), F.exp(pred)).alias(f"r2_exp_{m}"),
            groups.root_mean_square(F.exp(pred) - F.exp(truth)).alias(f"rmse_{m}"),
            F.avg(res).alias(f"mean_{m}"),
            F.stddev_pop(res).alias(f"sd_{m}"),
        ]
    table = predicted.rollup(month).agg(F.grouping(month).alias("total"), F.count("*").alias("n"), *cells)
    shown = F.when(F.col("total") == 1, F.lit(ALL)).otherwise(F.col(month)).alias("scope")
    names = [f"{c}_{m}" for m in models for c in ("n", "r2", "r2_exp", "rmse", "mean", "sd")]
    return table.select(shown, "n", *names)


def residuals_against(predicted: DataFrame, residual: str, keys: Sequence[str], predictors: Sequence[str]) -> DataFrame:
    """Long (predictor, value) rows with the residual of a fitted model; missing values stay out."""
    long = reshape.to_long(predicted, [*keys, residual], list(predictors), "predictor", "value")
    return long.filter(F.col("value").isNotNull() & F.col(residual).isNotNull())
