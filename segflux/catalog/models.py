"""Regression and forest models of log concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflux import dims
from segflux.catalog.base import inputs_of, query, rounded
from segflux.catalog.sites import table_of
from segflux.operators import forest, groups, regression, reshape
from segflux.plans import training, validation
from segflux.sources import sink

PLANTED = ("quantity", "discount")

_SPLIT = "((row_id % 6553600) * 1103515245 + 12345)"


def residual_table(b) -> DataFrame:
    """Measurements with a fixed linear predictor and its residual."""
    model = regression.Fit("lnco2", ("quantity", "discount", "psize"), 6.5, (0.02, -3.0, 0.01), 0, 0.0, 1.0)
    rows = b.site_meas.withColumn("lnco2", F.log("co2_uatm"))
    return regression.with_prediction(rows, model, "pred", "res")


@query(
    "train_test_split",
    f"SELECT row_id, CAST(CASE WHEN {_SPLIT} % 6553600 < 4915200 THEN 1 ELSE 0 END AS INT) AS train FROM site_meas",
)
def train_test_split(b):
    """Repeatable 75/25 split by row key."""
    return b.site_meas.select("row_id", forest.is_training(F.col("row_id")).cast("int").alias("train"))


@query(
    "cv_folds",
    f"SELECT CAST({_SPLIT} // 65536 % 10 AS INT) AS fold, count(*) AS n FROM site_meas GROUP BY ALL",
)
def cv_folds(b):
    """Rows per cross-validation fold."""
    return b.site_meas.groupBy(forest.fold_of(F.col("row_id")).alias("fold")).agg(F.count("*").alias("n"))


_OLS_SQL = """
    SELECT term, round(CASE term WHEN 'intercept' THEN my - b1 * m1 - b2 * m2 WHEN 'quantity' THEN b1 ELSE b2 END, 6) + 0e0 AS estimate,
           n, round(r2, 7) + 0e0 AS r2, round(1e0 - (1e0 - r2) * (n - 1) / (n - 3), 7) + 0e0 AS adj_r2
    FROM (SELECT *, (b1 * c1 + b2 * c2) / vy AS r2 FROM (
            SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2
            FROM (SELECT count(*) AS n, avg(quantity) AS m1, avg(discount) AS m2, avg(ln(co2_uatm)) AS my,
                         var_pop(quantity) AS v1, var_pop(discount) AS v2, var_pop(ln(co2_uatm)) AS vy,
                         covar_pop(quantity, discount) AS c12, covar_pop(quantity, ln(co2_uatm)) AS c1,
                         covar_pop(discount, ln(co2_uatm)) AS c2 FROM site_meas) AS s) AS t) AS u,
         (VALUES ('intercept'), ('quantity'), ('discount')) AS k(term)"""


@query("multi_ols", _OLS_SQL)
def multi_ols(b):
    """Multiple regression from one pass of moments: coefficients and fit quality."""
    rows = b.site_meas.withColumn("lnco2", F.log("co2_uatm"))
    model = regression.fit(regression.factor(rows, "lnco2", PLANTED), PLANTED)
    terms = [("intercept", model.intercept), *zip(model.predictors, model.slopes, strict=True)]
    data = [(t, v, model.n, model.r2, model.adjusted_r2) for t, v in terms]
    table = b.spark.createDataFrame(data, "term string, estimate double, n long, r2 double, adj_r2 double")
    return rounded(table, "term n", estimate=6, r2=7, adj_r2=7)


@query(
    "ols_fitted",
    f"""SELECT row_id, round(p, 6) + 0e0 AS fitted, round(p - y, 6) + 0e0 AS residual
        FROM (SELECT row_id, ln(co2_uatm) AS y, my + b1 * (quantity - m1) + b2 * (discount - m2) AS p FROM site_meas,
              (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2
               FROM (SELECT avg(quantity) AS m1, avg(discount) AS m2, avg(ln(co2_uatm)) AS my, var_pop(quantity) AS v1,
                            var_pop(discount) AS v2, covar_pop(quantity, discount) AS c12,
                            covar_pop(quantity, ln(co2_uatm)) AS c1, covar_pop(discount, ln(co2_uatm)) AS c2
                     FROM site_meas) AS s) AS t) AS u""",
)
def ols_fitted(b):
    """Fitted values and residuals of the multiple regression on every row."""
    rows = b.site_meas.withColumn("lnco2", F.log("co2_uatm"))
    model = regression.fit(regression.factor(rows, "lnco2", PLANTED), PLANTED)
    table = regression.with_prediction(rows, model, "fitted", "residual")
    return rounded(table, "row_id", fitted=6, residual=6)


@query("vif", """
    SELECT k.term, round(1e0 / (1e0 - r * r), 7) + 0e0 AS vif
    FROM (SELECT corr(quantity, discount) AS r FROM site_meas) AS c, (VALUES ('quantity'), ('discount')) AS k(term)""")
def vif(b):
    rows = b.site_meas.withColumn("lnco2", F.log("co2_uatm"))
    factors = regression.inflation_factors(regression.factor(rows, "lnco2", PLANTED), PLANTED)
    return rounded(b.spark.createDataFrame(list(factors.items()), "term string, vif double"), "term", vif=7)


# --- least squares in SQL -----------------------------------------------------------------------
# The correlations of all variables as one list of lists, swept pivot by pivot.

_REGRESSION_ROWS = (
    "(SELECT * REPLACE (CASE WHEN popdens = CAST('-inf' AS DOUBLE) THEN -15e0 ELSE popdens END AS popdens) FROM train_log)"
)


def _sweep_sql(m: str, k: str, sign: str, size: int) -> str:
    """The matrix swept on pivot k; a sign of -1 takes a swept pivot out again."""
    at = f"range(1, {size + 1})"
    return (
        f"[[CASE WHEN i = {k} AND j = {k} THEN -1e0 / {m}[{k}][{k}] WHEN i = {k} THEN {sign} * {m}[{k}][j] / {m}[{k}][{k}] "
        f"WHEN j = {k} THEN {sign} * {m}[i][{k}] / {m}[{k}][{k}] "
        f"ELSE {m}[i][j] - {m}[i][{k}] * {m}[{k}][j] / {m}[{k}][{k}] END FOR j IN {at}] FOR i IN {at}]"
    )


def _swept_sql(tag: str, predictors, source: str, search: bool) -> str:
    """CTEs that end in ``done_<tag>``: one row with counts, means, lengths and the swept matrix ``m``.

    All predictors are swept in, one recursion step each; with ``search`` moves by the step criterion follow.
    """
    names = [*predictors, "lnco2"]
    size = len(names)
    finite = " AND ".join(f"isfinite({c}) AND {c} IS NOT NULL" for c in names)
    matrix = ", ".join(
        "[" + ", ".join("1e0" if i == j else f"corr({a}, {b})" for j, b in enumerate(names)) + "]" for i, a in enumerate(names)
    )
    steps = f"""rows_{tag} AS (SELECT {', '.join(names)} FROM {source} AS s WHERE {finite}),
    base_{tag} AS (
        SELECT count(*) AS n, [{', '.join(f'avg({c})' for c in names)}] AS mean, [{', '.join(f'stddev_pop({c})' for c in names)}] AS sd,
               [{matrix}] AS m FROM rows_{tag}),
    full_{tag} AS (
        SELECT 1 AS k, n, mean, sd, m FROM base_{tag}
        UNION ALL SELECT k + 1, n, mean, sd, {_sweep_sql('m', 'k', '1e0', size)} FROM full_{tag} WHERE k < {size}),
    in_{tag} AS (
        SELECT 0 AS step, n, mean, sd, m, [true FOR i IN range(1, {size})] AS inside,
               n * ln(m[{size}][{size}] * sd[{size}] * sd[{size}]) + 2e0 * {size} AS crit
        FROM full_{tag} WHERE k = {size})"""
    if not search:
        return f"{steps}, done_{tag} AS (SELECT * FROM in_{tag})"
    moved = (
        f"[n * ln((m[{size}][{size}] - m[j][{size}] * m[j][{size}] / m[j][j]) * sd[{size}] * sd[{size}]) "
        f"+ 2e0 * (len(list_filter(inside, lambda x: x)) + CASE WHEN inside[j] THEN 0e0 ELSE 2e0 END) FOR j IN range(1, {size})]"
    )
    return steps + f""",
    walk_{tag} AS (
        SELECT *, {moved} AS moves FROM in_{tag}
        UNION ALL
        SELECT step, n, mean, sd, m, inside, crit, {moved} FROM (
            SELECT step + 1 AS step, n, mean, sd, {_sweep_sql('m', 'b', '(CASE WHEN inside[b] THEN -1e0 ELSE 1e0 END)', size)} AS m,
                   [CASE WHEN j = b THEN NOT inside[j] ELSE inside[j] END FOR j IN range(1, {size})] AS inside, moves[b] AS crit
            FROM (SELECT *, list_position(moves, list_min(moves)) AS b FROM walk_{tag}) AS w WHERE moves[b] < crit - 1e-9) AS x),
    done_{tag} AS (SELECT * FROM walk_{tag} ORDER BY step DESC LIMIT 1)"""


def _rounds_sql(search: bool, source: str = _REGRESSION_ROWS, rounds=dims.STEPWISE_ROUNDS, digits: int = 6) -> str:
    """Coefficients, inflation factors (as logarithms) and fit quality of every round."""
    ctes, parts = [], []
    for i, predictors in enumerate(rounds):
        size = len(predictors) + 1
        ctes.append(_swept_sql(f"r{i}", predictors, source, search))
        listed = ", ".join(f"'{p}'" for p in predictors)
        parts.append(f"""
            SELECT {i + 1} AS round, term, estimate, vif, n, n * (ln(2e0 * pi()) + 1e0) + crit + 2e0 AS aic, r2,
                   1e0 - (1e0 - r2) * (n - 1) / (n - p - 1) AS adj_r2
            FROM (
                SELECT n, crit, p, 1e0 - m[{size}][{size}] AS r2, unnest(list_concat(['intercept'], [{listed}])) AS term,
                       unnest(list_concat([true], inside)) AS used,
                       unnest(list_concat(
                           [mean[{size}] - list_sum([CASE WHEN inside[j] THEN m[j][{size}] * sd[{size}] / sd[j] * mean[j] ELSE 0e0 END FOR j IN range(1, {size})])],
                           [m[j][{size}] * sd[{size}] / sd[j] FOR j IN range(1, {size})])) AS estimate,
                       unnest(list_concat([NULL], [-m[j][j] FOR j IN range(1, {size})])) AS vif
                FROM (SELECT *, len(list_filter(inside, lambda x: x)) AS p FROM done_r{i}) AS d) AS u
            WHERE used""")
    return f"""WITH RECURSIVE {', '.join(ctes)}
        SELECT CAST(round AS INT) AS round, term, n, round(estimate, {digits}) + 0e0 AS estimate, round(ln(vif), {digits - 1}) + 0e0 AS ln_vif,
               round(aic, 3) + 0e0 AS aic, round(r2, 6) + 0e0 AS r2, round(adj_r2, 6) + 0e0 AS adj_r2
        FROM ({' UNION ALL '.join(parts)}) AS t"""


def _model_table(b, models, digits: int = 6) -> DataFrame:
    """One row per coefficient of (fit, inflation factors) pairs."""
    rows = []
    for i, (model, factors) in enumerate(models):
        summary = (model.n, model.aic, model.r2, model.adjusted_r2)
        rows.append((i + 1, "intercept", model.intercept, None, *summary))
        rows += [(i + 1, p, s, factors[p], *summary) for p, s in zip(model.predictors, model.slopes, strict=True)]
    table = b.spark.createDataFrame(
        rows, "round int, term string, estimate double, vif double, n long, aic double, r2 double, adj_r2 double"
    )
    table = table.withColumn("ln_vif", F.log("vif"))
    return rounded(table, "round term n", estimate=digits, ln_vif=digits - 1, aic=3, r2=6, adj_r2=6)


@query("stepwise_aic", _rounds_sql(search=True))
def stepwise_aic(b):
    """Four rounds of stepwise selection: coefficients, inflation factors, criterion, fit."""
    rounds = training.stepwise_rounds(sink.materialize(table_of(b), "training"))
    return _model_table(b, [(model, factors) for model, factors, _ in rounds])


@query("ols_rounds", _rounds_sql(search=False, digits=4))
def ols_rounds(b):
    """The full models of the four rounds: multiple regression on 11, 9, 8 and 7 predictors."""
    rows = sink.materialize(training.regression_rows(table_of(b)), "training")
    models = []
    for predictors in dims.STEPWISE_ROUNDS:
        m = regression.factor(rows, "lnco2", predictors)
        models.append((regression.fit(m, predictors), regression.inflation_factors(m, predictors)))
    # The predictors of the test data are nearly collinear, and the check works on normal equations.
    return _model_table(b, models, digits=4)


_PLANTED_ROWS = """(SELECT quantity, discount, CAST(psize AS DOUBLE) AS psize, lat,
    sin(row_id % 1000003) AS noise, cos(row_id % 999983) AS more, ln(co2_uatm) AS lnco2 FROM site_meas)"""
_PLANTED_ROUNDS = (("quantity", "discount", "psize"), ("quantity", "noise", "more"), ("quantity", "discount", "psize", "lat", "noise", "more"))


@query("stepwise_planted", _rounds_sql(search=True, source=_PLANTED_ROWS, rounds=_PLANTED_ROUNDS))
def stepwise_planted(b):
    """Stepwise selection on a response with a planted signal and predictors that are noise."""
    rows = b.site_meas.select(
        "quantity", "discount", F.col("psize").cast("double").alias("psize"), "lat", F.log("co2_uatm").alias("lnco2"),
        F.sin(F.col("row_id") % 1000003).alias("noise"), F.cos(F.col("row_id") % 999983).alias("more"),
    )
    rows = sink.materialize(rows, "planted")
    models = []
    for predictors in _PLANTED_ROUNDS:
        m = regression.factor(rows, "lnco2", predictors)
        model, _ = regression.stepwise(m, predictors)
        models.append((model, regression.inflation_factors(m, model.predictors)))
    return _model_table(b, models)


_LINE = validation.LINE_PREDICTORS
_LINE_SIZE = len(_LINE) + 1
_LINE_SLOPES = [f"m[{j + 1}][{_LINE_SIZE}] * sd[{_LINE_SIZE}] / sd[{j + 1}]" for j in range(len(_LINE))]
_LINE_CTES = _swept_sql(
    "line", _LINE, f"(SELECT * FROM {_REGRESSION_ROWS} AS q WHERE {_SPLIT} % 6553600 < 4915200)", search=False
) + f""",
    tested AS (
        SELECT row_id, mon, lnco2, {', '.join(_LINE)}, pred_lm, pred_lm - lnco2 AS res_lm FROM (
            SELECT q.*, mean[{_LINE_SIZE}] + {' + '.join(f'({b}) * ({c} - mean[{j + 1}])' for j, (c, b) in enumerate(zip(_LINE, _LINE_SLOPES)))} AS pred_lm
            FROM {_REGRESSION_ROWS} AS q, done_line WHERE {_SPLIT} % 6553600 >= 4915200) AS p)"""


@query("validation_linear", f"""WITH RECURSIVE {_LINE_CTES}
    SELECT CASE WHEN grouping(mon) = 1 THEN 'all' ELSE mon END AS scope, count(*) AS n, count(pred_lm) AS n_lm,
           round(regr_r2(lnco2, pred_lm), 6) + 0e0 AS r2_lm, round(regr_r2(exp(lnco2), exp(pred_lm)), 6) + 0e0 AS r2_exp_lm,
           round(sqrt(sum((exp(pred_lm) - exp(lnco2)) * (exp(pred_lm) - exp(lnco2))) / 2e0 / count(*)), 4) + 0e0 AS rmse_lm,
           round(avg(res_lm), 6) + 0e0 AS mean_lm, round(stddev_pop(res_lm), 6) + 0e0 AS sd_lm
    FROM tested GROUP BY GROUPING SETS ((mon), ())""")
def validation_linear(b):
    """The line fitted on the training quarters, judged on the held-out one, per month and in all."""
    rows = sink.materialize(training.regression_rows(table_of(b)), "training")
    found = validation.predictions(validation.held_out(rows), validation.linear_model(rows), None, ["row_id", "mon", "lnco2"])
    table = validation.accuracy(found, models=("lm",))
    return rounded(table, "scope n n_lm", r2_lm=6, r2_exp_lm=6, rmse_lm=4, mean_lm=6, sd_lm=6)


@query("model_validation")
def model_validation(b):
    """Line and forest side by side on the held-out quarter, per month and in all."""
    rows = sink.materialize(training.regression_rows(table_of(b)), "training")
    found = validation.predictions(validation.held_out(rows), validation.linear_model(rows), _fitted(rows), ["row_id", "mon", "lnco2"])
    digits = {f"{c}_{m}": d for m in ("lm", "rf") for c, d in (("r2", 6), ("r2_exp", 6), ("rmse", 4), ("mean", 6), ("sd", 6))}
    return rounded(validation.accuracy(found), "scope n n_lm n_rf", **digits)


@query("validation_residuals", f"""WITH RECURSIVE {_LINE_CTES}
    SELECT row_id, predictor, round(value, 6) + 0e0 AS value, round(res_lm, 6) + 0e0 AS res_lm FROM (
        UNPIVOT (SELECT row_id, res_lm, {', '.join(_LINE)} FROM tested) ON {', '.join(_LINE)} INTO NAME predictor VALUE value) AS u
    WHERE value IS NOT NULL AND res_lm IS NOT NULL""")
def validation_residuals(b):
    """Held-out residuals of the fitted line against each of its predictors, long."""
    rows = sink.materialize(training.regression_rows(table_of(b)), "training")
    found = validation.predictions(validation.held_out(rows), validation.linear_model(rows), None, ["row_id", *_LINE])
    long = validation.residuals_against(found, "res_lm", ["row_id"], _LINE)
    return rounded(long, "row_id predictor", value=6, res_lm=6)


@query(
    "prediction_r2",
    """SELECT mon, count(*) AS n, round(regr_r2(lnco2, pred), 6) + 0e0 AS r2, round(regr_r2(exp(lnco2), exp(pred)), 6) + 0e0 AS r2_exp
       FROM residuals GROUP BY mon""",
)
def prediction_r2(b):
    """Truth regressed on prediction, per month, in log and in original space."""
    return rounded(regression.prediction_r2(residual_table(b), ["mon"], "lnco2", "pred"), "mon n", r2=6, r2_exp=6)


@query(
    "residual_columns",
    """SELECT row_id, round(pred, 7) + 0e0 AS pred, round(res, 8) + 0e0 AS res, round(exp(pred) - exp(lnco2), 3) + 0e0 AS pco2diff,
              round((exp(pred) - exp(lnco2)) / exp(lnco2) * 100e0, 5) + 0e0 AS pco2d FROM residuals""",
)
def residual_columns(b):
    """Residual, back-transformed difference and percent difference."""
    table = residual_table(b).withColumn("pco2diff", F.exp("pred") - F.exp("lnco2"))
    table = table.withColumn("pco2d", F.col("pco2diff") / F.exp("lnco2") * 100.0)
    return rounded(table, "row_id", pred=7, res=8, pco2diff=3, pco2d=5)


@query(
    "rmse_by_month",
    """SELECT mon, count(*) AS n, round(sqrt(sum((exp(pred) - exp(lnco2)) * (exp(pred) - exp(lnco2))) / 2e0 / count(*)), 4) + 0e0 AS rmse
       FROM residuals GROUP BY mon""",
)
def rmse_by_month(b):
    """Root mean square difference per month, halved inside as published."""
    diff = F.exp("pred") - F.exp("lnco2")
    table = residual_table(b).groupBy("mon").agg(F.count("*").alias("n"), groups.root_mean_square(diff).alias("rmse"))
    return rounded(table, "mon n", rmse=4)


@query(
    "normal_fit",
    "SELECT mon, round(avg(res), 8) + 0e0 AS mean, round(stddev_pop(res), 7) + 0e0 AS sd FROM residuals GROUP BY mon",
)
def normal_fit(b):
    """Normal distribution fitted to the residuals of every month."""
    table = residual_table(b).groupBy("mon").agg(*groups.normal_fit(F.col("res")))
    return rounded(table, "mon", mean=8, sd=7)


@query(
    "residuals_long",
    """SELECT row_id, predictor, value, round(res, 8) + 0e0 AS res FROM (
         UNPIVOT (SELECT row_id, res, quantity, discount, CAST(psize AS DOUBLE) AS psize FROM residuals)
         ON quantity, discount, psize INTO NAME predictor VALUE value) AS u""",
)
def residuals_long(b):
    """Residuals against each predictor, long."""
    table = residual_table(b).withColumn("psize", F.col("psize").cast("double"))
    long = reshape.to_long(table, ["row_id", "res"], ["quantity", "discount", "psize"], "predictor", "value")
    return rounded(long, "row_id predictor value", res=8)


def _forest_rows(b) -> DataFrame:
    table = training.regression_rows(table_of(b))
    return sink.materialize(table.select("row_id", "lat", "mon", "lnco2", *dims.FOREST_PREDICTORS), "forest-rows")


def _fitted(rows: DataFrame, importance: bool = False) -> forest.Forest:
    """The forest of 500 trees on the training quarters."""
    train = rows.filter(forest.is_training(F.col("row_id")))
    return forest.train(train, "lnco2", dims.FOREST_PREDICTORS, importance=importance)


@query("rf_train_predict")
def rf_train_predict(b):
    """Forest on 15 predictors, scored on the held-out quarter."""
    rows = _forest_rows(b)
    held = rows.filter(~forest.is_training(F.col("row_id")))
    table = forest.score(_fitted(rows), held, dims.FOREST_PREDICTORS, ["row_id", "mon", "lnco2"], "pred_rf")
    return rounded(table, "row_id mon", lnco2=6, pred_rf=6)


@query("rf_importance")
def rf_importance(b):
    """Out-of-bag permutation importance of the 15 predictors, most important first."""
    table = forest.permutation_importance(_fitted(_forest_rows(b), importance=True))
    return rounded(table, "pred", importance=6).orderBy(F.desc("importance"), "pred")


def _out_of_fold(b) -> DataFrame:
    return forest.cross_validate(_forest_rows(b), "row_id", "lnco2", dims.FOREST_PREDICTORS, ["mon"])


@query("cv_summary")
def cv_summary(b):
    """10-fold cross-validation per month: r-squared, mean error and spread, averaged over folds."""
    metrics = forest.fold_metrics(_out_of_fold(b).filter(F.col("mon") != dims.ANNUAL), "mon", "lnco2")
    return rounded(forest.fold_summary(metrics, "mon"), "mon", r2=6, mnerr=6, sderr=6)


_COMPLETE = " AND ".join(f"{p} IS NOT NULL" for p in dims.FOREST_PREDICTORS)


@query(
    "cv_rows",
    f"""SELECT row_id, mon, round(lnco2, 7) + 0e0 AS lnco2, CAST({_SPLIT} // 65536 % 10 AS INT) AS fold, true AS in_range
        FROM train WHERE {_COMPLETE}""",
)
def cv_rows(b):
    """Out-of-fold predictions: every complete row once, in its fold, within the range of the responses."""
    scored = _out_of_fold(b)
    low, high = scored.agg(F.min("lnco2"), F.max("lnco2")).first()
    table = scored.withColumn("in_range", F.col("prediction").between(low, high))
    return rounded(table, "row_id mon fold in_range", lnco2=7)


@query(
    "forest_rows",
    f"""SELECT row_id, mon, round(lnco2, 7) + 0e0 AS lnco2,
               CAST(CASE WHEN {_SPLIT} % 6553600 < 4915200 THEN 1 ELSE 0 END AS INT) AS train,
               CAST({_SPLIT} // 65536 % 10 AS INT) AS fold, true AS in_range
        FROM train WHERE {_COMPLETE}""",
)
def forest_rows(b):
    """Rows the forests see: training or held out, fold, and whether a prediction lies in the range of all responses."""
    rows = _forest_rows(b)
    train = forest.is_training(F.col("row_id"))
    low, high = rows.filter(train).agg(F.min("lnco2"), F.max("lnco2")).first()
    kept = ["row_id", "mon", "lnco2"]
    table = forest.score(_fitted(rows), rows, dims.FOREST_PREDICTORS, kept, "pred_rf").select(
        *kept,
        train.cast("int").alias("train"),
        forest.fold_of(F.col("row_id")).alias("fold"),
        F.col("pred_rf").between(low, high).alias("in_range"),
    )
    return rounded(table, "row_id mon train fold in_range", lnco2=7)


def _scored_reaches(b, model: forest.Forest) -> DataFrame:
    i = inputs_of(b)
    features = training.reach_features(
        i.reach.join(i.reach_basin, "comid"), i.uparea, i.air_temp, i.basin_climate, i.basin_npp, i.basin_soil_resp, i.basin_static
    )
    return forest.score(model, features, dims.FOREST_PREDICTORS, ["comid", "month"], "ln_pco2")


@query("score_reaches")
def score_reaches(b):
    """Concentration of every segment and month from the forest on all 15 predictors."""
    scored = _scored_reaches(b, _fitted(_forest_rows(b)))
    return rounded(scored.withColumn("pco2", F.exp("ln_pco2")), "comid month", pco2=4)


@query(
    "score_reaches_rows",
    """SELECT r.comid, m.month, true AS in_range
       FROM reach r JOIN reach_basin USING (comid) JOIN basin USING (hybas_id) JOIN uparea_table u USING (comid) CROSS JOIN months m
       WHERE r.slope > 0 AND u.uparea > 0""",
)
def score_reaches_rows(b):
    """Which segments and months are scored, and whether every score lies in the range of the responses."""
    rows = _forest_rows(b)
    low, high = rows.agg(F.min("lnco2"), F.max("lnco2")).first()
    scored = _scored_reaches(b, _fitted(rows))
    return scored.select("comid", "month", F.col("ln_pco2").between(low, high).alias("in_range"))
