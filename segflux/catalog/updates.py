"""Quantile filters and quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from segflux.catalog.base import OPTIONS, inputs_of, query, rounded
from segflux.catalog.sites import table_of
from segflux.functions import nulls
from segflux.operators import quantiles
from segflux.plans import training

LISTED_BASINS = ("10", "20", "30", "40", "50", "60", "70", "80")


@query(
    "filter_quantile",
    """SELECT predictor, count(*) AS n, round(min(value), 7) + 0e0 AS low
       FROM train_all, (SELECT quantile_cont(sph, 0.01) AS q FROM train_log WHERE sph IS NOT NULL) AS w
       WHERE NOT (predictor = 'sph' AND value < q) AND NOT (predictor = 'sdensity' AND value < 1e0)
         AND NOT (predictor = 'ssodicity' AND value > 5e0) AND NOT (predictor = 'sconductivity' AND value > 0.3e0)
       GROUP BY predictor""".replace(
        "train_all",
        "(UNPIVOT train_log ON lnco2, "
        + ", ".join(c for c in training.PREDICTORS)
        + " INTO NAME predictor VALUE value)",
    ),
)
def filter_quantile(b):
    """Values of one predictor below its 1 % quantile are dropped, others by fixed limits."""
    long = training.histogram_values(table_of(b))
    table = long.groupBy("predictor").agg(F.count("*").alias("n"), F.min("value").alias("low"))
    return rounded(table, "predictor n", low=7)


@query(
    "subset_quantiles",
    f"""SELECT round(quantile_cont(m, 0.05), 6) + 0e0 AS q05, round(quantile_cont(m, 0.95), 6) + 0e0 AS q95
        FROM (SELECT comid, avg(pco2) AS m FROM reach_month WHERE hybas_id IN {LISTED_BASINS} GROUP BY comid) AS t""",
)
def subset_quantiles(b):
    """Spread of the yearly mean concentration over the segments of listed basins."""
    from segflux.plans import reaches

    table = reaches.listed_concentration_quantiles(inputs_of(b), OPTIONS, LISTED_BASINS)
    return table.agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 6).alias(n) for p, n in ((0.05, "q05"), (0.95, "q95"))])


@query(
    "global_quantiles",
    """SELECT p, round(v, 7) + 0e0 AS value FROM (
         SELECT unnest([0e0, 0.001e0, 0.25e0, 0.5e0, 0.75e0, 0.995e0, 1e0]) AS p,
                unnest(quantile_cont(q, [0, 0.001, 0.25, 0.5, 0.75, 0.995, 1])) AS v FROM q_month) AS t""",
)
def global_quantiles(b):
    """Exact quantiles of all monthly discharges."""
    from segflux.sources import ingest

    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.995, 1.0]
    q = quantiles.exact_quantiles(ingest.monthly_statistic(b.discharge), "q", probs)
    rows = [(p, q[p]) for p in probs]
    return rounded(b.spark.createDataFrame(rows, "p double, value double"), "p", value=7)
