"""Shared SQL views of the checks: the test-data bindings and the intermediate tables.

Written for an independent engine; nothing here is run by Spark.
"""

from __future__ import annotations

from segflux.sources.bindings import MONTH_ROWS

_MM = [f"{m:02d}" for m in range(1, 13)]


def _values() -> str:
    rows = ", ".join(f"({m}, '{mon}', {d}, {qf!r}e0, {tg!r}e0)" for m, mon, d, qf, tg in MONTH_ROWS)
    return f"SELECT * FROM (VALUES {rows}) AS t(month, mon, days, qf, tg)"


def floor_q(x: str) -> str:
    return f"CASE WHEN {x} < 1e-9 THEN 1e-9 ELSE {x} END"


def velocity(q: str) -> str:
    return f"exp(0.12e0 * ln({q}) - 1.06e0)"


def water_temp(ta: str) -> str:
    return f"CASE WHEN 0.67e0 * {ta} + 7.45e0 < 0e0 THEN 0e0 ELSE 0.67e0 * {ta} + 7.45e0 END"


def schmidt(t: str) -> str:
    return f"(1742e0 - 91.24e0 * {t} + 2.208e0 * {t} * {t} - 0.0219e0 * {t} * {t} * {t})"


def exchange(slope: str, v: str, sc: str) -> str:
    return (
        f"CASE WHEN {slope} <= 0.01e0 OR 9.81e0 * {slope} * {v} <= 0.02e0 "
        f"THEN 2841e0 * {slope} * {v} + 2.02e0 "
        f"ELSE exp(1.18e0 * ln(9.81e0 * {slope} * {v}) + 6.43e0) END * sqrt(600e0 / {sc})"
    )


def excess(p: str, t: str) -> str:
    return f"({p} - 380e0) * pow(10e0, 0.00007e0 * {t} * {t} - 0.016e0 * {t} - 1.11e0)"


def clamp(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END"


def strict(x: str) -> str:
    return f"CASE WHEN count(*) = count({x}) THEN sum({x}) END"


def div(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} END"


def qlevel(x: str) -> str:
    return (
        f"CASE WHEN {x} < 50 THEN 'ARID' WHEN {x} < 200 THEN 'MOD1' WHEN {x} < 500 THEN 'MOD2' "
        f"WHEN {x} < 1000 THEN 'WET1' WHEN {x} >= 1000 THEN 'WET2' END"
    )


def band(x: str, names=("Polar", "North Temperate", "Tropical", "South Temperate")) -> str:
    return (
        f"CASE WHEN {x} > 56 THEN '{names[0]}' WHEN {x} > 23.5e0 THEN '{names[1]}' "
        f"WHEN {x} >= -23.5e0 THEN '{names[2]}' WHEN {x} < -23.5e0 THEN '{names[3]}' END"
    )


SHORT = ("Polar", "N Temperate", "Tropical", "S Temperate")


def _dry_alt() -> str:
    def part(c):
        lines = {
            4: [("-0.005", "0.023", "0.27"), ("-0.0028", "0.012", "0.127")],
            3: [("-0.008", "0.028", "0.44"), ("-0.0018", "0.011", "0.058")],
            2: [("-0.009", "0.029", "0.61"), ("-0.0021", "0.011", "0.088")],
            1: [("-0.009", "0.029", "0.77"), ("-0.0019", "0.017", "0.026")],
        }
        whens = " ".join(
            f"WHEN strm_order = {so} THEN ({v[c][0]}e0) * prec + {v[c][1]}e0 * tavg + {v[c][2]}e0"
            for so, v in lines.items()
        )
        return f"least(greatest(CASE WHEN strm_order > 4 THEN 0e0 {whens} END, 0e0), 0.9e0)"

    return f"({part(0)}) * ({part(1)})"


DRY_ALT = _dry_alt()


def _fit(y: str, x: str, keep: str, name: str) -> str:
    f = f"FILTER (WHERE {keep} AND {y} IS NOT NULL)"
    return (
        f"CASE WHEN count({y}) {f} >= 2 THEN regr_slope({y}, {x}) {f} END AS slope_{name}, "
        f"CASE WHEN count({y}) {f} >= 2 THEN regr_intercept({y}, {x}) {f} END AS icept_{name}, "
        f"CASE WHEN count({y}) {f} >= 2 AND regr_syy({y}, {x}) {f} <> 0 THEN regr_r2({y}, {x}) {f} END AS r2_{name}"
    )


_OBS = "length_m * width_obs / 1e6 * CASE WHEN width_obs >= 0.3e0 THEN 1e0 WHEN width_obs < 0.3e0 THEN 0e0 END"

VIEWS = {
    "months": _values(),
    # --- bindings -------------------------------------------------------------------------
    "basin": """
        SELECT CAST(c_custkey AS VARCHAR) AS hybas_id, c_nationkey * 6e0 - 72e0 AS lat,
               CASE WHEN c_nationkey >= 12 THEN 'N' ELSE 'S' END AS hemis,
               CASE WHEN c_custkey % 97 = 5 THEN NULL ELSE c_acctbal / 7e0 END AS runoff,
               concat('FR_', CAST(c_custkey % 3 + 11 AS VARCHAR)) AS frclass,
               1000e0 + c_custkey % 500 AS basin_area
        FROM customer""",
    "segment": """
        SELECT comid, hybas_id, region, strm_order, length_m, slope,
               0.4e0 * power(4e0, strm_order - 2) * (0.5e0 + price / 5e5)
                 * CASE WHEN comid % 53 = 0 THEN 1e-4 WHEN comid % 211 = 0 THEN 1e2 ELSE 1e0 END AS q_mean,
               0.4e0 + (comid % 997) * 1e-2 AS q_cv,
               8e0 * power(4e0, strm_order - 2) * (1 + comid % 5)
                 * CASE WHEN comid % 101 = 0 THEN 1e-2 WHEN comid % 103 = 0 THEN 1e3 ELSE 1e0 END AS uparea
        FROM (SELECT o_orderkey AS comid, CAST(o_custkey AS VARCHAR) AS hybas_id, o_totalprice AS price,
                     CAST(1 + o_orderkey % 8 AS INT) AS region,
                     CASE WHEN o_orderkey % 31 < 16 THEN 1 WHEN o_orderkey % 31 < 24 THEN 2
                          WHEN o_orderkey % 31 < 28 THEN 3 WHEN o_orderkey % 31 < 30 THEN 4 ELSE 5 END AS strm_order,
                     o_totalprice / 1e2 AS length_m,
                     (1 + o_orderkey % 997) * 1e-4
                       / CASE WHEN o_orderkey % 31 < 16 THEN 1e0 WHEN o_orderkey % 31 < 24 THEN 2e0
                              WHEN o_orderkey % 31 < 28 THEN 4e0 WHEN o_orderkey % 31 < 30 THEN 8e0 ELSE 16e0 END AS slope
              FROM orders) AS r""",
    "reach": "SELECT region, comid, strm_order, slope, length_m FROM segment",
    "reach_basin": "SELECT comid, hybas_id FROM segment",
    "uparea_table": "SELECT comid, uparea FROM segment",
    "discharge": """
        SELECT comid, 0 AS month, 'Qmean' AS stat, q_mean AS value FROM segment
        UNION ALL SELECT comid, 0, 'Qstd', q_mean * q_cv FROM segment
        UNION ALL SELECT comid, month, 'Qmean', q_mean * qf FROM segment CROSS JOIN months""",
    "air_temp": """
        SELECT r.comid, m.month, 27e0 - 0.45e0 * abs(b.lat) + 0.3e0 * b.lat * m.tg AS ta
        FROM segment r JOIN basin b ON r.hybas_id = b.hybas_id CROSS JOIN months m""",
    "reach_pco2": """
        SELECT comid, month, 300e0 + 40e0 * (comid % 97) + 20e0 * month AS pco2 FROM segment CROSS JOIN months""",
    "observed_width": "SELECT l_orderkey AS comid, l_extendedprice / 5e2 AS width_mean FROM lineitem",
    "basin_ice": """
        SELECT hybas_id, month, CASE WHEN abs(lat) > 50e0 AND lat * tg < 0e0 THEN 0.8e0 ELSE 0e0 END AS ice
        FROM basin CROSS JOIN months""",
    "basin_climate": """
        SELECT hybas_id, month, 27e0 - 0.45e0 * abs(lat) + 0.3e0 * lat * tg AS tavg,
               20e0 + 5e0 * month + coalesce(runoff, 0e0) / 2e1 AS prec
        FROM basin CROSS JOIN months""",
    "basin_annual": """
        SELECT hybas_id, 27e0 - 0.45e0 * abs(lat) AS ann_temp, 630e0 + coalesce(runoff, 0e0) AS ann_prec FROM basin""",
    "basin_npp": """
        SELECT hybas_id, month, 900e0 + 2e0 * lat * tg AS gpp, 400e0 + 1e0 * lat * tg AS npp
        FROM basin CROSS JOIN months""",
    "basin_soil_resp": "SELECT hybas_id, month, 1e0 + 5e-3 * lat * tg AS prs FROM basin CROSS JOIN months",
    "site_meas": """
        SELECT row_id, site_no, lat, mon, quantity, discount, psize,
               exp(6e0 + 2e-2 * quantity - 3e0 * discount + 1e-2 * psize + price / 1e5) AS co2_uatm
        FROM (SELECT ((l_orderkey * 10 + l_linenumber) * 200003 + l_partkey) * 4001
                       + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS row_id, l_suppkey AS site_no,
                     s_nationkey * 6e0 - 72e0 AS lat,
                     CASE WHEN (l_orderkey * 10 + l_linenumber) % 13 = 0 THEN 'Ann' ELSE m.mon END AS mon,
                     l_quantity AS quantity, l_discount AS discount, p_size AS psize, l_extendedprice AS price
              FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
                   JOIN months m ON m.month = month(l_shipdate)) AS s""",
    "site_order": """
        SELECT s_suppkey AS site_no, CAST(CASE WHEN s_suppkey % 6 IN (0, 5) THEN 0 WHEN s_suppkey % 12 = 4 THEN 255 ELSE s_suppkey % 6 END AS INT) AS so
        FROM supplier""",
    "site_area": "SELECT s_suppkey AS site_no, 10e0 + s_suppkey * 7e0 AS area FROM supplier",
    "site_pop": "SELECT s_suppkey AS site_no, "
    + ", ".join(f"(s_suppkey % 11) * {i}e0 AS p{i}" for i in range(1, 5)) + " FROM supplier",
    "site_climate": "SELECT s_suppkey AS site_no, "
    + ", ".join(f"s_acctbal / 500e0 + {int(m)} AS tavg_{m}" for m in _MM) + ", s_acctbal / 500e0 AS tavg_ann, "
    + ", ".join(f"10e0 * {int(m)} + s_suppkey % 40 AS prec_{m}" for m in _MM)
    + ", s_acctbal / 500e0 AS prec_ann FROM supplier",
    "site_npp": "SELECT s_suppkey AS site_no, s_acctbal / 500e0 AS gpp, s_acctbal / 1000e0 AS npp, "
    + ", ".join(f"60e0 * {int(m)} + s_suppkey % 30 AS gpp_{m}" for m in _MM) + ", "
    + ", ".join(f"25e0 * {int(m)} + s_suppkey % 20 AS npp_{m}" for m in _MM) + " FROM supplier",
    "site_soil_resp": "SELECT s_suppkey AS site_no, "
    + ", ".join(f"2e-1 * {int(m)} + (s_suppkey % 13) * 1e-1 AS sr_{m}" for m in _MM)
    + ", s_acctbal / 500e0 AS sr_ann, s_acctbal / 900e0 AS ar_ann, s_acctbal / 1100e0 AS hr_ann FROM supplier",
    "site_wetland": "SELECT s_suppkey AS site_no, (s_suppkey % 17) * 1e-2 AS wetland FROM supplier",
    "site_terrain": """
        SELECT s_suppkey AS site_no, 1e0 + s_suppkey * 3e0 AS elev, 1e-1 * (1 + s_suppkey % 50) AS slop FROM supplier""",
    "site_soil": """
        SELECT s_suppkey AS site_no, (s_suppkey % 4) * 3e0 AS sgravel, (s_suppkey % 5) * 1e1 AS ssand,
               (s_suppkey % 8) * 4e0 AS ssilt, (s_suppkey % 6) * 6e0 AS sclay,
               8e-1 + (s_suppkey % 10) * 1e-1 AS sdensity, (s_suppkey % 7) * 5e-1 AS soc,
               3e0 + (s_suppkey % 9) * 5e-1 AS sph, (s_suppkey % 12) * 2e0 AS scec,
               4e1 + (s_suppkey % 3) * 2e1 AS sbs, (s_suppkey % 14) * 1e0 AS steb,
               (s_suppkey % 15) * 2e-1 AS scaco3, (s_suppkey % 16) * 1e-1 AS scaso4,
               (s_suppkey % 18) * 5e-1 AS ssodicity, (s_suppkey % 19) * 2.5e-2 AS sconductivity
        FROM supplier""",
    "site_flow": """
        SELECT s_suppkey AS site_no, (1 + s_suppkey % 37) * 1e-3 AS slope, 5e-1 + (s_suppkey % 23) * 2e0 AS ann_q
        FROM supplier""",
    "site_reach": """
        SELECT s_suppkey AS site_no,
               CASE WHEN s_suppkey % 10 = 0 THEN 'unknown' ELSE CAST(s_suppkey * 3 AS VARCHAR) END AS comid_txt
        FROM supplier""",
    # --- segments -------------------------------------------------------------------------
    "wk": f"""
        SELECT hybas_id, runoff, {qlevel('runoff')} AS qlevel, lat, hemis, frclass, basin_area,
               concat(hemis, coalesce({qlevel('runoff')}, 'NA'), substr(frclass, 4, 3)) AS wkbasin
        FROM basin""",
    "wk_climate": """
        SELECT wkbasin, month, avg(tavg) AS tavg, avg(prec) AS prec
        FROM basin_climate JOIN wk USING (hybas_id) GROUP BY wkbasin, month""",
    "q_month": f"""
        SELECT comid, month, {floor_q('value')} AS q FROM discharge WHERE stat = 'Qmean' AND month BETWEEN 1 AND 12""",
    "q_ann": f"""
        SELECT comid, max(CASE WHEN stat = 'Qmean' THEN {floor_q('value')} END) AS q_year,
               max(CASE WHEN stat = 'Qstd' THEN {floor_q('value')} END) AS q_std
        FROM discharge WHERE month = 0 GROUP BY comid""",
    "reach_temp": f"""
        SELECT comid, month, ta, {water_temp('ta')} AS tw FROM air_temp""",
    "reach_k": f"""
        SELECT region, comid, month, q, ta, tw, {velocity('q')} AS v, {schmidt('tw')} AS sc,
               {exchange('slope', velocity('q'), schmidt('tw'))} AS k
        FROM reach JOIN q_month USING (comid) LEFT JOIN reach_temp USING (comid, month)""",
    "reach_a": """
        SELECT s.comid, s.region, s.strm_order, s.slope, s.length_m, w.hybas_id, w.wkbasin, w.qlevel, w.runoff,
               q.q_year, q.q_std, q.q_std / q.q_year AS cv_raw,
               CASE WHEN s.comid IN (61, 31) THEN 35e0 ELSE s.uparea END AS uparea
        FROM segment s JOIN q_ann q ON q.comid = s.comid JOIN wk w ON w.hybas_id = s.hybas_id
        WHERE s.hybas_id <> '0'""",
    "reach_b": f"""
        SELECT *, {clamp('cv_raw', 'cv_lo', 'cv_hi')} AS q_cv,
               CASE qlevel WHEN 'ARID' THEN exp(2.1e0 + 0.43e0 * ln(q_year)) WHEN 'MOD1' THEN exp(2.1e0 + 0.47e0 * ln(q_year))
                    WHEN 'MOD2' THEN exp(2.24e0 + 0.47e0 * ln(q_year)) WHEN 'WET1' THEN exp(2.2e0 + 0.45e0 * ln(q_year))
                    WHEN 'WET2' THEN exp(1.92e0 + 0.49e0 * ln(q_year)) END AS width_year,
               q_year / uparea * 3.6e0 * 24e0 * 365e0 AS runoff_reach,
               1e0 / (1e0 + exp(11e0 + 4e0 * ln(q_year))) AS dryout_year
        FROM reach_a, (SELECT quantile_cont(cv_raw, 0.001) AS cv_lo, quantile_cont(cv_raw, 0.995) AS cv_hi FROM reach_a) AS w""",
    "reach_c": f"""
        SELECT *, 0.074e0 * ln(q_cv) - 0.026e0 * ({clamp('ln(runoff_reach)', '1.6e0', '8.5e0')})
               - 0.011e0 * ({clamp('ln(q_year)', '(-7e0)', '10e0')}) + 0.36e0 AS exponent_raw
        FROM reach_b""",
    "reach_static": """
        SELECT *, width_year / pow(q_year, exponent) AS coefficient
        FROM (SELECT *, CASE WHEN exponent_raw < e_lo THEN e_lo ELSE exponent_raw END AS exponent
              FROM reach_c, (SELECT quantile_cont(exponent_raw, 0.01) AS e_lo FROM reach_c) AS w) AS t
        WHERE wkbasin NOT IN ('NARID15')""",
    "obs_min": """
        SELECT comid, min(width_mean) AS width_observed FROM observed_width GROUP BY comid HAVING min(width_mean) >= 90e0""",
    "reach_month": f"""
        SELECT r.comid, r.region, r.strm_order, r.slope, r.length_m, r.hybas_id, r.wkbasin, r.qlevel, r.q_year,
               r.width_year, r.dryout_year, r.exponent, r.coefficient, m.month, m.q, t.tw, p.pco2, x.k,
               r.coefficient * pow(m.q, r.exponent) AS width,
               CASE WHEN m.q >= 60e0 THEN 0e0 ELSE 1e0 / (1e0 + exp(11e0 + 4e0 * ln(m.q))) END AS dryout,
               {excess('p.pco2', 't.tw')} AS co2,
               CASE WHEN o.width_observed IS NULL THEN 1e0
                    WHEN o.width_observed / r.width_year > 2e0 THEN 2e0
                    ELSE o.width_observed / r.width_year END AS width_ratio,
               coalesce(o.width_observed, r.width_year) AS width_year_obs
        FROM reach_static r JOIN q_month m ON m.comid = r.comid
             LEFT JOIN reach_temp t ON t.comid = r.comid AND t.month = m.month
             LEFT JOIN reach_pco2 p ON p.comid = r.comid AND p.month = m.month
             LEFT JOIN reach_k x ON x.comid = r.comid AND x.month = m.month
             LEFT JOIN obs_min o ON o.comid = r.comid""",
    "channel": """
        SELECT *, CASE WHEN width >= 0.3e0 THEN 1e0 WHEN width < 0.3e0 THEN 0e0 END AS is_channel,
               length_m * width / 1e6 * CASE WHEN width >= 0.3e0 THEN 1e0 WHEN width < 0.3e0 THEN 0e0 END AS area
        FROM reach_month""",
    "kept": f"""
        SELECT *, {_OBS} AS obs_area FROM (
          SELECT *, width * width_ratio AS width_obs FROM reach_month
          WHERE hybas_id NOT IN ('104', '204', '504')
            AND comid IN (SELECT comid FROM reach_k WHERE month = 4 AND k IS NOT NULL)) AS t""",
    # --- stream orders --------------------------------------------------------------------
    "so_summary": f"""
        SELECT wkbasin, month, strm_order, n, length_km, width_m, area_km2, dry_km2, {div('dry_km2', 'area_km2')} AS dry_ratio,
               ({DRY_ALT}) * area_km2 AS dry_alt_km2, CASE WHEN area_km2 <> 0 THEN {DRY_ALT} END AS dry_alt_ratio,
               {div('k_area', 'area_km2')} AS k, {div('co2_area', 'area_km2')} AS co2, {div('pco2_area', 'area_km2')} AS pco2
        FROM (SELECT wkbasin, month, strm_order, count(*) AS n, {strict('length_m * is_channel / 1e3')} AS length_km,
                     CASE WHEN count(*) = count(width) THEN avg(width * is_channel) END AS width_m,
                     {strict('area')} AS area_km2, {strict('area * dryout')} AS dry_km2,
                     coalesce(sum(k * (area - area * dryout)), 0e0) AS k_area,
                     coalesce(sum(co2 * (area - area * dryout)), 0e0) AS co2_area,
                     coalesce(sum(pco2 * (area - area * dryout)), 0e0) AS pco2_area
              FROM channel GROUP BY wkbasin, month, strm_order) AS s
        LEFT JOIN wk_climate USING (wkbasin, month)""",
    "depths": """
        SELECT wkbasin, CAST(CASE WHEN count(DISTINCT CASE WHEN strm_order <= 5 THEN strm_order END) = 5 THEN 4
                                  WHEN count(DISTINCT CASE WHEN strm_order <= 4 THEN strm_order END) = 4 THEN 3
                                  ELSE 2 END AS INT) AS depth
        FROM reach_month GROUP BY wkbasin""",
    "so_ranked": """
        SELECT *, row_number() OVER (PARTITION BY wkbasin, month ORDER BY strm_order) AS rn
        FROM so_summary JOIN depths USING (wkbasin)""",
    "so_dry": """
        SELECT *, coalesce(max(CASE WHEN strm_order <= depth AND dry_ratio <> 0 THEN strm_order END)
                           OVER (PARTITION BY wkbasin, month), 0) AS dry_depth
        FROM so_ranked""",
    "so_x": """
        SELECT *, CASE WHEN width_m > 0 THEN ln(width_m) END AS ln_width, CASE WHEN length_km > 0 THEN ln(length_km) END AS ln_length,
               CAST(strm_order AS DOUBLE) AS o, rn <= dry_depth AND dry_depth >= 2 AS in_dry
        FROM so_dry""",
    "fits": f"""
        SELECT wkbasin, month, max(depth) AS depth, max(dry_depth) AS dry_depth,
               {_fit('ln_width', 'o', 'rn <= depth', 'width')}, {_fit('ln_length', 'o', 'rn <= depth', 'length')},
               {_fit('k', 'o', 'rn <= depth', 'k')}, {_fit('dry_ratio', 'o', 'in_dry', 'dry')},
               {_fit('dry_alt_ratio', 'o', 'in_dry', 'dry_alt')},
               max(abs(dry_alt_ratio)) FILTER (WHERE in_dry) AS max_dry_alt, avg(k) AS mean_k,
               max(co2) FILTER (WHERE strm_order = 1) AS co2_2, max(pco2) FILTER (WHERE strm_order = 1) AS pco2_2,
               {strict('dry_km2')} AS dry_1, {strict('dry_alt_km2')} AS dry_alt_1
        FROM so_x GROUP BY wkbasin, month""",
    "ends": """
        SELECT *, CASE WHEN round(slope_width, 5) <> 0 THEN (ln(0.3e0) - round(icept_width, 5)) / round(slope_width, 5) END AS end_order
        FROM fits""",
    "ext_orders": """
        SELECT e.*, u.ord FROM ends e, LATERAL (SELECT unnest(
          CASE WHEN e.end_order IS NULL THEN [CAST(NULL AS DOUBLE)]
               ELSE list_concat([CAST(i AS DOUBLE) FOR i IN
                 CASE WHEN ceil(e.end_order) >= 0 THEN generate_series(0, CAST(ceil(e.end_order) AS BIGINT))
                      ELSE generate_series(0, CAST(ceil(e.end_order) AS BIGINT), -1) END], [e.end_order]) END) AS ord) AS u""",
    "ext_a": """
        SELECT *, exp(icept_width + slope_width * ord) AS width_m, exp(icept_length + slope_length * ord) AS length_km,
               CASE WHEN slope_k > 0 THEN mean_k ELSE icept_k + slope_k * ord END AS k,
               CASE WHEN dry_depth >= 2 THEN icept_dry + slope_dry * ord ELSE 0e0 END AS ratio,
               CASE WHEN dry_depth >= 2 AND max_dry_alt <> 0 THEN icept_dry_alt + slope_dry_alt * ord ELSE 0e0 END AS ratio_alt
        FROM ext_orders""",
    "ext_b": """
        SELECT *, width_m * length_km / 1e3 AS area_km2,
               CASE WHEN ratio > 1e0 THEN width_m * length_km / 1e3 ELSE width_m * length_km / 1e3 * ratio END AS dry_km2,
               CASE WHEN ratio_alt > 1e0 THEN width_m * length_km / 1e3 ELSE width_m * length_km / 1e3 * ratio_alt END AS dry_alt_km2
        FROM ext_a""",
    "ext_c": """
        SELECT *, area_km2 - dry_km2 AS eff_km2, co2_2 * k * 4.38e0 AS flux,
               co2_2 * k * 4.38e0 * (area_km2 - dry_km2) / 1e3 AS emission FROM ext_b""",
    "ext_totals": f"""
        SELECT wkbasin, month, max(end_order) AS end_order, max(r2_width) AS r2_width, max(r2_length) AS r2_length,
               max(r2_dry) AS r2_dry, max(r2_dry_alt) AS r2_dry_alt, max(r2_k) AS r2_k, max(dry_1) AS dry_1,
               max(dry_alt_1) AS dry_alt_1, {strict('length_km')} AS length_2, {strict('area_km2')} AS area_2,
               {strict('dry_km2')} AS dry_2, {strict('dry_alt_km2')} AS dry_alt_2, {strict('eff_km2')} AS eff_2,
               CASE WHEN count(*) FILTER (WHERE eff_km2 <> 0) > 0 THEN ({strict('k * eff_km2')}) / sum(eff_km2)
                    WHEN count(*) = count(eff_km2) THEN 0e0 END AS k_2,
               max(co2_2) AS co2_2, max(pco2_2) AS pco2_2,
               CASE WHEN count(*) FILTER (WHERE eff_km2 <> 0) > 0 THEN ({strict('flux * eff_km2')}) / sum(eff_km2)
                    WHEN count(*) = count(eff_km2) THEN 0e0 END AS flux_2,
               {strict('emission')} AS emission_2
        FROM ext_c GROUP BY wkbasin, month""",
    # --- basins ---------------------------------------------------------------------------
    "basin_list": "SELECT hybas_id, min(wkbasin) AS wkbasin FROM kept GROUP BY hybas_id",
    "basin_share": """
        SELECT l.hybas_id, l.wkbasin, b.basin_area, sum(b.basin_area) OVER (PARTITION BY l.wkbasin) AS wkbasin_area,
               b.basin_area / sum(b.basin_area) OVER (PARTITION BY l.wkbasin) AS area_ratio
        FROM basin_list l LEFT JOIN basin b USING (hybas_id)""",
    "obs_totals": f"""
        SELECT hybas_id, month, {strict('obs_area')} AS area, {strict('obs_area * dryout')} AS dry,
               {strict('obs_area * (1e0 - dryout)')} AS eff,
               CASE WHEN sum(obs_area * (1e0 - dryout)) <> 0 THEN ({strict('pco2 * obs_area * (1e0 - dryout)')}) / sum(obs_area * (1e0 - dryout)) END AS pco2,
               CASE WHEN sum(obs_area * (1e0 - dryout)) <> 0 THEN ({strict('k * obs_area * (1e0 - dryout)')}) / sum(obs_area * (1e0 - dryout)) END AS k,
               CASE WHEN sum(obs_area * (1e0 - dryout)) <> 0 THEN ({strict('co2 * k * 4.38e0 * obs_area * (1e0 - dryout)')}) / sum(obs_area * (1e0 - dryout)) END AS flux,
               {strict('co2 * k * 4.38e0 * obs_area * (1e0 - dryout) / 1e3')} AS emission
        FROM kept GROUP BY hybas_id, month""",
    "part_1": """
        SELECT hybas_id, month, area, dry, eff * ice AS ice_area, eff - eff * ice AS eff, emission * (1e0 - ice) AS emission, pco2, k, flux
        FROM obs_totals LEFT JOIN basin_ice USING (hybas_id, month)""",
    "part_2": """
        SELECT hybas_id, month, s.area_ratio * area_2 AS area, s.area_ratio * dry_2 AS dry, s.area_ratio * eff_2 * ice AS ice_area,
               s.area_ratio * eff_2 - s.area_ratio * eff_2 * ice AS eff, s.area_ratio * emission_2 * (1e0 - ice) AS emission,
               pco2_2 AS pco2, k_2 AS k, flux_2 AS flux
        FROM basin_share s LEFT JOIN ext_totals USING (wkbasin) LEFT JOIN basin_ice USING (hybas_id, month)""",
    "combined": """
        SELECT hybas_id, month, a.area + b.area AS area, a.dry + b.dry AS dry, a.ice_area + b.ice_area AS ice_area,
               a.eff + b.eff AS eff, a.emission + b.emission AS emission,
               CASE WHEN a.eff + b.eff = 0 THEN 0e0 ELSE (CASE WHEN a.eff = 0 THEN 0e0 ELSE a.eff * a.pco2 END
                 + CASE WHEN b.eff = 0 THEN 0e0 ELSE b.eff * b.pco2 END) / (a.eff + b.eff) END AS pco2,
               CASE WHEN a.eff + b.eff = 0 THEN 0e0 ELSE (CASE WHEN a.eff = 0 THEN 0e0 ELSE a.eff * a.k END
                 + CASE WHEN b.eff = 0 THEN 0e0 ELSE b.eff * b.k END) / (a.eff + b.eff) END AS k,
               CASE WHEN a.eff + b.eff = 0 THEN 0e0 ELSE (CASE WHEN a.eff = 0 THEN 0e0 ELSE a.eff * a.flux END
                 + CASE WHEN b.eff = 0 THEN 0e0 ELSE b.eff * b.flux END) / (a.eff + b.eff) END AS flux
        FROM part_1 a LEFT JOIN part_2 b USING (hybas_id, month)""",
}

# --- measurement sites ------------------------------------------------------------------
_SOIL = ("sgravel", "ssand", "ssilt", "sclay", "sdensity", "soc", "sph", "scec", "sbs", "steb", "scaco3", "scaso4",
         "ssodicity", "sconductivity")
_DAYS = {mon: d for _, mon, d, _, _ in MONTH_ROWS}
_MONS = [mon for _, mon, _, _, _ in MONTH_ROWS]


def own_month(prefix: str, annual: str, per_month: str = "{x}") -> str:
    """CASE over the row's month label, with a formula for monthly values."""
    whens = " ".join(
        f"WHEN '{mon}' THEN " + per_month.format(x=f"{prefix}_{_MM[i]}", d=_DAYS[mon]) for i, mon in enumerate(_MONS)
    )
    return f"CASE mon {whens} WHEN 'Ann' THEN {annual} END"


def log_inf(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN CAST('-inf' AS DOUBLE) WHEN {x} > 0 THEN ln({x}) END"


LOGGED = ("area", "elev", "slop", "soc", "scec", "steb", "scaco3", "scaso4", "popdens")
STATIC = ("area", "popdens", "tavg_ann", "prec_ann", "gpp", "npp", "ar_ann", "hr_ann", "wetland", "elev", "slop", *_SOIL, "k")
LONG_COLUMNS = (
    "tavg_00", "prec_00", "gpp_00", "npp_00", "sr_00", "ar_ann", "hr_ann", "area", "slop", "elev", "wetland", "popdens",
    *("sgravel", "ssand", "ssilt", "sclay", "sdensity", "soc", "sph", "scec", "sbs", "steb", "scaco3", "scaso4",
      "ssodicity", "sconductivity"),
)

VIEWS["site_wide"] = f"""
    SELECT o.site_no, CASE WHEN o.site_no % 2 <> 0 THEN o.so WHEN o.so = 0 THEN -1 WHEN o.so = 255 THEN 0 ELSE o.so END AS so, a.area,
           (p.p1 + p.p2 + p.p3 + p.p4) / 4e0 AS popdens, c.* EXCLUDE (site_no), n.* EXCLUDE (site_no),
           s.* EXCLUDE (site_no), w.wetland * 100e0 AS wetland, t.elev, tan(t.slop * pi() / 180e0) AS slop,
           {', '.join(f'nullif(i.{c}, 0e0) AS {c}' for c in _SOIL)}, 2841e0 * f.slope * {velocity('f.ann_q')} + 2.02e0 AS k
    FROM site_order o LEFT JOIN site_area a USING (site_no) LEFT JOIN site_pop p USING (site_no)
         LEFT JOIN site_climate c USING (site_no) LEFT JOIN site_npp n USING (site_no)
         LEFT JOIN site_soil_resp s USING (site_no) LEFT JOIN site_wetland w USING (site_no)
         LEFT JOIN site_terrain t USING (site_no) LEFT JOIN site_soil i USING (site_no) LEFT JOIN site_flow f USING (site_no)"""
VIEWS["train"] = f"""
    SELECT m.row_id, m.site_no, m.lat, m.mon, m.co2_uatm, ln(m.co2_uatm) AS lnco2, w.so, {', '.join('w.' + c for c in STATIC)},
           {own_month('tavg', 'tavg_ann')} AS tavg_00,
           {own_month('prec', 'prec_ann', '{x} * (365e0 / {d}e0)')} AS prec_00,
           {own_month('gpp', 'gpp')} AS gpp_00, {own_month('npp', 'npp')} AS npp_00,
           {own_month('sr', 'sr_ann', '{x} * 365e0')} AS sr_00
    FROM site_meas m JOIN site_wide w ON w.site_no = m.site_no WHERE w.so <> -1"""
VIEWS["train_log"] = f"""
    SELECT * REPLACE ({', '.join(f'{log_inf(c)} AS {c}' for c in LOGGED)}) FROM train"""
VIEWS["train_long"] = f"""
    SELECT lnco2, popdens_raw, predictor, value FROM (
      UNPIVOT (SELECT l.*, t.popdens AS popdens_raw FROM train_log l JOIN (SELECT row_id, popdens FROM train) AS t USING (row_id))
      ON {', '.join(LONG_COLUMNS)} INTO NAME predictor VALUE value) AS u
    WHERE value IS NOT NULL AND isfinite(value)"""
# Measurements off open water.
VIEWS["site_clean"] = "SELECT m.* FROM site_meas m JOIN site_wide w ON w.site_no = m.site_no WHERE w.so <> -1"
VIEWS["cycle_located"] = """
    SELECT m.row_id, m.lat, m.mon, m.co2_uatm AS pco2, TRY_CAST(s.comid_txt AS BIGINT) AS comid
    FROM site_clean m JOIN site_reach s USING (site_no) WHERE TRY_CAST(s.comid_txt AS BIGINT) IS NOT NULL"""
VIEWS["cycle_observed"] = f"""
    SELECT comid, month, {band('lat', SHORT)} AS lat_band, co2n, row_id
    FROM (SELECT *, pco2 / avg(pco2) OVER (PARTITION BY comid) AS co2n FROM cycle_located) AS c JOIN months USING (mon)"""
VIEWS["cycle_modelled"] = f"""
    SELECT p.comid, p.month, {band('l.lat', SHORT)} AS lat_band,
           p.pco2 / avg(p.pco2) OVER (PARTITION BY p.comid)
             * CASE WHEN {band('l.lat', SHORT)} = 'S Temperate' THEN
               [1.04e0, 1.14e0, 1.11e0, 1.05e0, 0.98e0, 0.97e0, 0.94e0, 0.94e0, 0.96e0, 0.98e0, 1.01e0, 1.02e0][p.month]
               ELSE 1e0 END AS co2n
    FROM reach_pco2 p JOIN (SELECT comid, avg(lat) AS lat FROM cycle_located WHERE mon <> 'Ann' GROUP BY comid) AS l USING (comid)"""
VIEWS["cycle"] = """
    SELECT 'observed' AS source, lat_band, month, comid, co2n, row_id FROM cycle_observed
    UNION ALL SELECT 'modelled', lat_band, month, comid, co2n, CAST(NULL AS BIGINT) FROM cycle_modelled"""
# Fixed linear predictor of the planted signal; residuals are known in closed form.
VIEWS["residuals"] = """
    SELECT row_id, site_no, lat, mon, ln(co2_uatm) AS lnco2, quantity, discount, psize,
           6.5e0 + 2e-2 * quantity - 3e0 * discount + 1e-2 * psize AS pred,
           6.5e0 + 2e-2 * quantity - 3e0 * discount + 1e-2 * psize - ln(co2_uatm) AS res
    FROM site_meas"""
