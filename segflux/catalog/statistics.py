"""Distribution statistics: histograms, densities, smooths."""

from __future__ import annotations

from pyspark.sql import functions as F

from segflux import dims
from segflux.catalog.base import query, rounded
from segflux.catalog.models import residual_table
from segflux.catalog.sites import clean_of, table_of
from segflux.catalog.views import SHORT, band
from segflux.functions import classify
from segflux.operators import distribution, groups
from segflux.plans import seasonality as season
from segflux.plans import training


@query(
    "histogram_by_group",
    """SELECT predictor, bin, count(*) AS n, round(lo, 7) + 0e0 AS low, round(hi, 7) + 0e0 AS high FROM (
         SELECT predictor, lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 50e0) + 1e-8), 49) END AS INT) AS bin
         FROM (SELECT predictor, value, min(value) OVER (PARTITION BY predictor) AS lo, max(value) OVER (PARTITION BY predictor) AS hi
               FROM (UNPIVOT train_log ON lnco2, """
    + ", ".join(training.PREDICTORS)
    + """ INTO NAME predictor VALUE value) AS u,
                    (SELECT quantile_cont(sph, 0.01) AS q FROM train_log WHERE sph IS NOT NULL) AS w
               WHERE isfinite(value) AND NOT (predictor = 'sph' AND value < q) AND NOT (predictor = 'sdensity' AND value < 1e0)
                 AND NOT (predictor = 'ssodicity' AND value > 5e0) AND NOT (predictor = 'sconductivity' AND value > 0.3e0)) AS v) AS b
       GROUP BY predictor, bin, lo, hi""",
)
def histogram_by_group(b):
    """50 bins over each predictor's own range."""
    table = training.predictor_histograms(table_of(b), 50)
    return rounded(table, "predictor bin n", low=7, high=7)


@query(
    "histogram_log",
    f"""SELECT clmregion, CAST(floor(log10(co2_uatm) / 0.06e0 + 1e-8) AS INT) AS bin, count(*) AS n
        FROM (SELECT {band('lat', SHORT)} AS clmregion, co2_uatm FROM site_clean WHERE co2_uatm BETWEEN 30e0 AND 20000e0) AS t
        GROUP BY ALL""",
)
def histogram_log(b):
    """Counts on a log axis by climate region."""
    table = clean_of(b).withColumn("clmregion", classify.climate_band(F.col("lat"), dims.BANDS_SHORT))
    return distribution.histogram_log(table, ["clmregion"], "co2_uatm").select("clmregion", "bin", "n")


@query(
    "histogram_density",
    """SELECT mon, bin, n, round(n / (sum(n) OVER (PARTITION BY mon) * (4e0 / 30e0)), 7) + 0e0 AS density FROM (
         SELECT mon, CAST(least(floor((res + 2e0) / (4e0 / 30e0) + 1e-8), 29) AS INT) AS bin, count(*) AS n
         FROM residuals WHERE res BETWEEN -2e0 AND 2e0 GROUP BY ALL) AS t""",
)
def histogram_density(b):
    """Residual density histogram per month: 30 bins over [-2, 2]."""
    table = distribution.histogram_density(residual_table(b), ["mon"], "res", -2.0, 2.0, 30)
    return rounded(table, "mon bin n", density=7)


@query(
    "histogram_density_overall",
    """SELECT bin, n, round(n / (sum(n) OVER () * 0.12e0), 7) + 0e0 AS density FROM (
         SELECT CAST(least(floor((res + 3e0) / 0.12e0 + 1e-8), 49) AS INT) AS bin, count(*) AS n
         FROM residuals WHERE res BETWEEN -3e0 AND 3e0 GROUP BY ALL) AS t""",
)
def histogram_density_overall(b):
    """Residual density histogram of all rows: 50 bins over [-3, 3]."""
    table = distribution.histogram_density(residual_table(b), [], "res", -3.0, 3.0, 50)
    return rounded(table, "bin n", density=7)


@query(
    "normal_density_grid",
    """SELECT mon, round(x, 8) + 0e0 AS x, round(exp(-0.5e0 * ((x - mean) / sd) * ((x - mean) / sd)) / (sd * sqrt(2e0 * pi())), 6) + 0e0 AS density
       FROM (SELECT mon, avg(res) AS mean, stddev_pop(res) AS sd FROM residuals GROUP BY mon) AS f,
            (SELECT -2e0 + 4e0 * i / 99e0 AS x FROM range(100) AS r(i)) AS g""",
)
def normal_density_grid(b):
    """Fitted normal density of the residuals on 100 points per month."""
    fits = residual_table(b).groupBy("mon").agg(*groups.normal_fit(F.col("res")))
    return rounded(distribution.normal_density_grid(fits, ["mon"]), "mon", x=8, density=6)


@query(
    "kde_by_group",
    """WITH kde_binned AS (SELECT lat_band, month, (floor(co2n / 0.01e0) + 0.5e0) * 0.01e0 AS c, count(*) AS w
                    FROM cycle_modelled WHERE co2n IS NOT NULL GROUP BY ALL),
         kde_width AS (SELECT lat_band, month, count(*) AS n, quantile_cont(co2n, 0.75) - quantile_cont(co2n, 0.25) AS iqr,
                          CASE WHEN count(*) > 1 THEN stddev_samp(co2n) END AS sd
                   FROM cycle_modelled WHERE co2n IS NOT NULL GROUP BY lat_band, month),
         kde_bw AS (SELECT lat_band, month, n, 0.9e0 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34e0) ELSE sd END * pow(CAST(n AS DOUBLE), -0.2e0) AS bw FROM kde_width)
       SELECT b.lat_band, b.month, CAST(g AS INT) AS point, round(g * 0.05e0, 6) + 0e0 AS x, round(bw, 6) + 0e0 AS bw,
              round(sum(w * exp(-0.5e0 * ((g * 0.05e0 - c) / nullif(bw, 0e0)) * ((g * 0.05e0 - c) / nullif(bw, 0e0))) / (nullif(bw, 0e0) * sqrt(2e0 * pi()))) / h.n, 6) + 0e0 AS density
       FROM kde_binned b JOIN kde_bw h ON h.month = b.month AND h.lat_band IS NOT DISTINCT FROM b.lat_band, range(45) AS r(g)
       GROUP BY b.lat_band, b.month, g, bw, h.n""",
)
def kde_by_group(b):
    """Kernel density of the modelled cycle per climate band and month."""
    located = season.located_measurements(clean_of(b), b.site_reach)
    cycle = season.modelled_cycle(located, b.reach_pco2_wide)
    table = distribution.kde_by_group(cycle, ["lat_band", "month"], "co2n")
    return rounded(table, "lat_band month point", x=6, bw=6, density=6)


@query(
    "seasonal_loess",
    """WITH loess_points AS (SELECT lat_band, month AS m, count(*) AS n, sum(co2n) AS s FROM cycle_modelled WHERE co2n IS NOT NULL GROUP BY ALL),
         loess_pairs AS (SELECT lat_band, m, n, s, x, abs(m - x) AS d FROM loess_points, (SELECT CAST(i AS INT) AS x FROM range(1, 13) AS r(i)) AS t),
         loess_seen AS (SELECT *, sum(n) OVER (PARTITION BY lat_band, x ORDER BY d) AS seen, sum(n) OVER (PARTITION BY lat_band, x) AS total FROM loess_pairs),
         loess_reach AS (SELECT lat_band, x, min(d) FILTER (WHERE seen >= floor(total * 0.75e0 + 1e-5)) * 1e0 AS h FROM loess_seen GROUP BY lat_band, x),
         loess_w AS (SELECT p.*, m - p.x AS u, CASE WHEN d < h THEN pow(1e0 - pow(d / h, 3), 3) WHEN d = 0 THEN 1e0 ELSE 0e0 END AS w
                     FROM loess_pairs p JOIN loess_reach h ON h.x = p.x AND h.lat_band IS NOT DISTINCT FROM p.lat_band),
         loess_sums AS (SELECT lat_band, x, sum(w * n) AS s0, sum(w * n * u) AS s1, sum(w * n * u * u) AS s2, sum(w * n * u * u * u) AS s3,
                               sum(w * n * u * u * u * u) AS s4, sum(w * s) AS t0, sum(w * s * u) AS t1, sum(w * s * u * u) AS t2
                        FROM loess_w GROUP BY lat_band, x)
       SELECT lat_band, x AS month, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
              / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)), 6) + 0e0 AS smooth FROM loess_sums""",
)
def seasonal_loess(b):
    """Local quadratic smooth of the modelled cycle over the year, per climate band."""
    located = season.located_measurements(clean_of(b), b.site_reach)
    cycle = season.modelled_cycle(located, b.reach_pco2_wide)
    return rounded(distribution.seasonal_loess(cycle, ["lat_band"], "month", "co2n"), "lat_band month", smooth=6)


@query(
    "count_by_region",
    f"""SELECT clmregion, n, 'N = ' || format('{{:,}}', n) AS label
        FROM (SELECT {band('lat', SHORT)} AS clmregion, count(*) AS n FROM site_clean GROUP BY ALL) AS t""",
)
def count_by_region(b):
    """Measurements per climate region with a display label."""
    table = clean_of(b).groupBy(
        classify.climate_band(F.col("lat"), dims.BANDS_SHORT).alias("clmregion")
    ).agg(F.count("*").alias("n"))
    return table.select("clmregion", "n", F.concat(F.lit("N = "), F.format_number("n", 0)).alias("label"))


@query(
    "seasonal_cycle_summary",
    """SELECT source, lat_band, month, count(*) AS n, round(avg(co2n), 7) + 0e0 AS co2n FROM cycle GROUP BY ALL""",
)
def seasonal_cycle_summary(b):
    """Mean cycle per source, climate band and month."""
    cycle = season.seasonality(clean_of(b), b.site_reach, b.reach_pco2_wide)
    return rounded(season.cycle_summary(cycle), "source lat_band month n", co2n=7)
