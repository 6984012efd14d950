"""Explicit schemas of the engine's input tables (no inference anywhere)."""

from __future__ import annotations



def _mm(prefix: str, kind: str = "double") -> str:
    return ", ".join(f"{prefix}_{i:02d} {kind}" for i in range(1, 13))


SCHEMAS = {
    # segment network
    "reach": "region int, comid long, strm_order int, slope double, length_m double",
    "discharge": "comid long, month int, stat string, value double",
    "air_temp": "comid long, month int, ta double",
    "uparea": "comid long, uparea double",
    "reach_basin": "comid long, hybas_id string",
    "reach_pco2": "comid long, month int, pco2 double",
    "reach_k": "comid long, month int, k double",
    "observed_width": "comid long, width_mean double",
    # basins
    "basin_hemis": "hybas_id string, hemis string",
    "basin_runoff": "hybas_id string, runoff double",
    "basin_regime": "hybas_id string, frclass string",
    "wk_climate": "wkbasin string, month int, tavg double, prec double",
    "basin_centroid": "hybas_id string, lat double",
    "basin_area": "hybas_id string, basin_area double",
    "basin_climate": "hybas_id string, ann_temp double, ann_prec double",
    "basin_npp": "hybas_id string, month int, gpp double, npp double",
    "basin_soil_resp": "hybas_id string, month int, prs double",
    "basin_ice": "hybas_id string, month int, ice double",
    # measurement sites
    "site_meas": "row_id long, site_no long, lat double, mon string, co2_uatm double",
    "site_order": "site_no long, so int",
    "site_area": "site_no long, area double",
    "site_pop": "site_no long, p1 double, p2 double, p3 double, p4 double",
    "site_climate": f"site_no long, {_mm('tavg')}, tavg_ann double, {_mm('prec')}, prec_ann double",
    "site_npp": f"site_no long, gpp double, npp double, {_mm('gpp')}, {_mm('npp')}",
    "site_soil_resp": f"site_no long, {_mm('sr')}, sr_ann double, ar_ann double, hr_ann double",
    "site_wetland": "site_no long, wetland double",
    "site_terrain": "site_no long, elev double, slop double",
    "site_soil": "site_no long, sgravel double, ssand double, ssilt double, sclay double, "
    "sdensity double, soc double, sph double, scec double, sbs double, steb double, "
    "scaco3 double, scaso4 double, ssodicity double, sconductivity double",
    "site_flow": "site_no long, slope double, ann_q double",
    "site_reach": "site_no long, comid_txt string",
}
