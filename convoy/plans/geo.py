"""Queries on positions, depots and bulk booking."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.functions import geo
from convoy.operators import board, routing, scan
from convoy.plans import derive as d
from convoy.plans.registry import query
from convoy.session import ensure_checkpoint_dir

_HAVERSINE = """2 * 6371.0::DOUBLE * asin(sqrt(least(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
   + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2), 1)))"""
_FREE_SQL = f"""{d.VEHICLES}, {d.DEPOTS}, {d.BOOKINGS},
  taken AS (SELECT depot_id, count(*) AS n FROM bookings WHERE booked_until > TIMESTAMP '{d.BOARD_NOW}' GROUP BY depot_id),
  free AS (SELECT dp.* FROM depots dp LEFT JOIN taken USING (depot_id) WHERE bays - coalesce(n, 0) > 0)"""
_NEAREST_SQL = f"""WITH {_FREE_SQL}, p AS (SELECT v.vehicle_id, f.depot_id, round({_HAVERSINE.format(a='v', b='f')}, 6) AS distance_km FROM vehicles v, free f),
   r AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY distance_km, depot_id) AS rn FROM p)
   SELECT vehicle_id, depot_id, distance_km FROM r WHERE rn = 1"""


def _depots(spark, sf_dir):
    return board.depot_occupancy(d.depots(spark, sf_dir), d.bookings(spark, sf_dir), F.lit(d.BOARD_NOW).cast("timestamp_ntz"))


def _nearest(spark, sf_dir, **options):
    found = routing.nearest_depot(d.vehicles(spark, sf_dir), _depots(spark, sf_dir), **options)
    return found.select("vehicle_id", "depot_id", F.round("distance_km", 6).alias("distance_km"))


@query("nearest_depot", "O-GEO-2", "O-GEO-3", "O-JOIN-12", sql=_NEAREST_SQL)
def nearest_depot(spark, sf_dir):
    return _nearest(spark, sf_dir)


@query("nearest_depot_cells", "O-GEO-3", sql=_NEAREST_SQL)
def nearest_depot_cells(spark, sf_dir):
    """The same search on cells refined twice, as for depots that crowd in a few places."""
    return _nearest(spark, sf_dir, least_cells=60_000)


@query("vehicle_position", "O-GEO-4",
       sql=f"""WITH {d.TEL}, {d.VEHICLES}, {d.DEPOTS}, tw AS (SELECT vin, arg_max(lat, seq) FILTER (lat IS NOT NULL) AS lat, arg_max(lon, seq) FILTER (lon IS NOT NULL) AS lon FROM tel GROUP BY vin)
               SELECT v.vehicle_id, coalesce(tw.lat, dp.lat) AS lat, coalesce(tw.lon, dp.lon) AS lon
               FROM vehicles v LEFT JOIN tw USING (vin) LEFT JOIN depots dp ON dp.depot_id = v.model_id % 10""")
def vehicle_position(spark, sf_dir):
    rows = d.telemetry(spark, sf_dir)
    state = rows.groupBy("vin").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("lat", "lon")])
    return routing.live_position(d.vehicles(spark, sf_dir), state, d.depots(spark, sf_dir)).select("vehicle_id", "lat", "lon")


def _request_order():
    return scan.number_chunk(F.col("vehicle_id"), 1000)


_BOOKED_SQL = f"""WITH RECURSIVE {_FREE_SQL}, open AS (SELECT row_number() OVER (ORDER BY depot_id) AS k, f.*, bays - coalesce(n, 0) AS free_bays FROM free f LEFT JOIN taken USING (depot_id)),
   asking AS (SELECT row_number() OVER (ORDER BY vehicle_id) AS i, vehicle_id, lat, lon FROM vehicles WHERE lat IS NOT NULL AND lon IS NOT NULL),
   far AS (SELECT i, vehicle_id, k, depot_id, round({_HAVERSINE.format(a='v', b='f')}, 6) AS distance_km FROM asking v, open f),
   near AS (SELECT i, list(k ORDER BY distance_km, depot_id) AS ks FROM far GROUP BY i),
   book(i, bays_left, k) AS (
     SELECT CAST(0 AS BIGINT), (SELECT list(CAST(free_bays AS BIGINT) ORDER BY k) FROM open), CAST(0 AS BIGINT)
     UNION ALL
     SELECT i, list_transform(bays_left, lambda x, j: x - CASE WHEN j = k THEN 1 ELSE 0 END), k
     FROM (SELECT near.i, bays_left, list_filter(ks, lambda c: bays_left[c] > 0)[1] AS k FROM book JOIN near ON near.i = book.i + 1) WHERE k IS NOT NULL)
   SELECT vehicle_id, depot_id, distance_km FROM book JOIN far USING (i, k)"""


@query("bulk_booking", "O-GEO-5", sql=_BOOKED_SQL)
def bulk_booking(spark, sf_dir):
    """All vehicles ask for a bay in order of their number, as if booked one by one."""
    ensure_checkpoint_dir(spark)
    booked = routing.assign_bays(d.vehicles(spark, sf_dir), _depots(spark, sf_dir), "vehicle_id", _request_order())
    return booked.withColumn("distance_km", F.round("distance_km", 6))


_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


@query("geohash_mask", "O-GEO-1", "O-VAL-10",
       sql=f"""WITH {d.VEHICLES}, r AS (SELECT *, CASE model_id % 4 WHEN 0 THEN 'fleet_admin' WHEN 1 THEN 'fleet_manager' WHEN 2 THEN 'technician' ELSE 'guest' END AS role,
         least(CAST(floor((lon + 180) / 360 * 8192) AS BIGINT), 8191) AS x, least(CAST(floor((lat + 90) / 180 * 4096) AS BIGINT), 4095) AS y FROM vehicles),
       g AS (SELECT *, role IN ('fleet_admin', 'fleet_manager') AS exact, array_to_string(list_transform(range(5), lambda j: substr('{_ALPHABET}', 1 + CAST(list_sum(list_transform(range(5),
         lambda b: ((CASE WHEN (5 * j + b) % 2 = 0 THEN x >> (12 - (5 * j + b) // 2) ELSE y >> (11 - (5 * j + b) // 2) END) & 1) << (4 - b))) AS INTEGER), 1)), '') AS hash FROM r)
       SELECT vehicle_id, role, CASE WHEN exact THEN lat END AS lat, CASE WHEN exact THEN lon END AS lon, CASE WHEN NOT exact THEN hash END AS geohash FROM g""")
def geohash_mask(spark, sf_dir):
    kind = F.col("model_id") % 4
    role = F.when(kind == 0, "fleet_admin").when(kind == 1, "fleet_manager").when(kind == 2, "technician").otherwise("guest")
    rows = d.vehicles(spark, sf_dir).withColumn("role", role)
    return rows.withColumn("_p", geo.masked_location(F.col("lat"), F.col("lon"), F.col("role"))).select("vehicle_id", "role", "_p.*")
