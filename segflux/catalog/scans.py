"""Reading and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from segflux.catalog.base import query, rounded, rounded_sql
from segflux.operators import groups
from segflux.plans import reaches
from segflux.catalog.base import inputs_of
from segflux.sources import ingest, sink


@query("scan_typed", "SELECT hybas_id, round(runoff, 10) + 0e0 AS runoff FROM basin")
def scan_typed(b):
    """Typed text scan: keys stay strings, empty fields become NULL."""
    path = sink.new_path(b.spark, "basin-runoff")
    sink.write_table(b.basin_runoff, path)
    return rounded(ingest.scan(b.spark, path, "basin_runoff"), "hybas_id", runoff=10)


@query(
    "scan_regions",
    """SELECT region, count(*) AS n, min(comid) AS first_comid, round(sum(slope), 7) + 0e0 AS slope_sum
       FROM reach GROUP BY region""",
)
def scan_regions(b):
    """Region directories read as one table."""
    path = sink.new_path(b.spark, "reach-regions")
    sink.write_regions(b.reach, path, b.reach.columns)
    table = ingest.scan_regions(b.spark, path, "reach")
    table = table.groupBy("region").agg(
        F.count("*").alias("n"), F.min("comid").alias("first_comid"), F.sum("slope").alias("slope_sum")
    )
    return rounded(table, "region n first_comid", slope_sum=7)


@query("discharge_bind", rounded_sql("region comid month q", "reach JOIN q_month USING (comid)"))
def discharge_bind(b):
    """Monthly mean discharge bound to segments by key."""
    return rounded(ingest.bind_discharge(b.reach, b.discharge), "region comid month q")


@query("sink_roundtrip", rounded_sql("region comid month", "reach_k", k=4))
def sink_roundtrip(b):
    """Exchange table written per region and read back."""
    path = sink.new_path(b.spark, "exchange")
    table = reaches.gas_transfer_by_reach(inputs_of(b))
    sink.write_regions(table, path, ["region", "comid", "month", "k"], fmt="parquet")
    back = ingest.scan(b.spark, path, "comid long, month int, k double, region int", fmt="parquet")
    return rounded(back, "region comid month", k=4)


@query(
    "union_parts",
    "SELECT comid, hybas_id FROM reach_basin WHERE hybas_id <> '0'",
)
def union_parts(b):
    """Two deliveries of one table appended by name, placeholders dropped."""
    first = b.reach_basin.filter(F.col("comid") % 2 == 0)
    second = b.reach_basin.filter(F.col("comid") % 2 == 1).select("hybas_id", "comid")
    return ingest.union_parts([first, second]).filter(F.col("hybas_id") != "0").select("comid", "hybas_id")


@query(
    "qc_null_counts",
    """SELECT 'hybas_id' AS column_name, count(*) - count(hybas_id) AS n_null, count(hybas_id) AS n_present FROM qc
       UNION ALL SELECT 'runoff', count(*) - count(runoff), count(runoff) FROM qc
       UNION ALL SELECT 'wkbasin', count(*) - count(wkbasin), count(wkbasin) FROM qc
       UNION ALL SELECT 'qlevel', count(*) - count(qlevel), count(qlevel) FROM qc""".replace(
        "FROM qc",
        "FROM (SELECT r.comid, w.hybas_id, w.runoff, w.wkbasin, w.qlevel FROM segment r "
        "LEFT JOIN wk w ON w.hybas_id = r.hybas_id AND w.hybas_id <> '0') AS qc",
    ),
)
def qc_null_counts(b):
    """Missing and present values after the lookups, one pass."""
    i = inputs_of(b)
    placed = i.reach_basin.filter(F.col("hybas_id") != "0")
    table = i.reach.join(placed, "comid", "left").join(reaches.basin_classes(i), "hybas_id", "left")
    return groups.null_tally(table, ["hybas_id", "runoff", "wkbasin", "qlevel"])


@query(
    "qc_key_mismatch",
    """SELECT count(*) FILTER (WHERE a.comid IS NOT NULL AND o.comid IS NULL) AS left_only,
              count(*) FILTER (WHERE a.comid IS NULL AND o.comid IS NOT NULL) AS right_only,
              count(*) FILTER (WHERE a.comid IS NOT NULL AND o.comid IS NOT NULL) AS "both"
       FROM (SELECT DISTINCT comid FROM reach) AS a
       FULL JOIN (SELECT DISTINCT comid FROM observed_width) AS o ON a.comid = o.comid""",
)
def qc_key_mismatch(b):
    return groups.key_mismatch(b.reach, b.observed_width, ["comid"])
