"""Nearest depot with a free bay, and booking many requests in order.

The search is one plan at every size. Pairs of map cells are refined level by level and dropped when the triangle
inequality proves that they cannot hold a nearest depot; requests then meet the depots of the cells that are left. A small
depot table is broadcast by Spark itself. Depots within a millimetre of each other's distance tie: the lowest id wins.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from convoy.functions.geo import EARTH_RADIUS_KM, haversine_km
from convoy.operators.scan import carried, chunk_window

_TOP_CELL_DEGREES = 9.0
_OPEN = 2**63 - 1  # cutoff of a depot that still has room
_DIGITS = 6  # of a distance in km, below which distances are equal
_SLACK = 1e-9  # of a chord on the unit sphere, above that of equal distances
DEPOTS_PER_REGION = 8192

# rows of bulk booking
_DEPOT, _HELD, _CHOSEN, _ASKING, _SUMMARY = range(5)
_ROW = [("region", "int"), ("kind", "int"), ("o", "long"), ("lat", "double"), ("lon", "double"), ("depot_id", "long"), ("bays", "long"), ("chord", "double")]
_ROW_SCHEMA = ", ".join(f"{n} {t}" for n, t in _ROW)
_ROW_NAMES = [n for n, _ in _ROW]


def _cell_sizes(n_sites: int) -> list[float]:
    """Cell widths in degrees, each a third of the one before, until cells outnumber the sites."""
    sizes, cells = [_TOP_CELL_DEGREES], (360 / _TOP_CELL_DEGREES) * (180 / _TOP_CELL_DEGREES)
    while cells < n_sites:
        sizes.append(sizes[-1] / 3)
        cells *= 9
    return sizes


def _columns(size: float) -> int:
    return round(360 / size)


def _cell(lat: Column, lon: Column, size: float) -> Column:
    top_x, top_y = _columns(size) - 1, round(180 / size) - 1
    x = F.least(F.floor((lon + 180) / F.lit(size)), F.lit(top_x)).cast("long")
    y = F.least(F.floor((lat + 90) / F.lit(size)), F.lit(top_y)).cast("long")
    return y * F.lit(_columns(size)) + x


def _centre_distance(a: Column, b: Column, size: float) -> Column:
    n = _columns(size)

    def lat(cell: Column) -> Column:
        return (F.floor(cell / F.lit(n)) + 0.5) * F.lit(size) - 90

    def lon(cell: Column) -> Column:
        return (cell % n + 0.5) * F.lit(size) - 180

    return haversine_km(lat(a), lon(a), lat(b), lon(b))


def _prune(pairs: DataFrame, size: float) -> DataFrame:
    """Keeps a cell pair only if its least distance can beat the sure distance to a site.

    A point lies within ``reach`` of its cell's centre. ``_first`` and ``_last`` bound the requests of the cell ``_v``;
    ``_cutoff`` is the latest request that a site of ``_s`` takes. The bound rests on sites that take every request of
    the cell. A window gives it, so that each level is in the plan once.
    """
    reach = EARTH_RADIUS_KM * math.radians(size) * math.sqrt(2) / 2
    pairs = pairs.filter(F.col("_cutoff") >= F.col("_first")).withColumn("_d", _centre_distance(F.col("_v"), F.col("_s"), size))
    sure = F.when(F.col("_cutoff") >= F.col("_last"), F.col("_d") + 2 * reach)
    bounded = pairs.withColumn("_bound", F.min(sure).over(Window.partitionBy("_v")))
    return bounded.filter(F.col("_bound").isNull() | (F.col("_d") - 2 * reach <= F.col("_bound") + 1e-5)).select("_v", "_s")


def _nearest(points: DataFrame, sites: DataFrame, n_sites: int, key: str, order: str | None) -> DataFrame:
    """``points`` with depot_id and distance_km of the nearest site whose ``cutoff`` is not before their ``order``."""
    sizes = _cell_sizes(n_sites)
    names = [f"_c{i}" for i in range(len(sizes))]
    located = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("_o", (F.col(order) if order else F.lit(0)).cast("long"))
    placed = located.withColumns({n: _cell(F.col("lat"), F.col("lon"), s) for n, s in zip(names, sizes)})
    depots = sites.withColumns({n: _cell(F.col("lat"), F.col("lon"), s) for n, s in zip(names, sizes)})
    wanted, latest = [F.min("_o").alias("_first"), F.max("_o").alias("_last")], F.max("cutoff").alias("_cutoff")

    last_top = _columns(sizes[0]) * round(180 / sizes[0]) - 1
    all_top = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last_top).cast("long")))
    site_cells = depots.groupBy(F.col(names[0]).alias("_s")).agg(latest)
    pairs = placed.groupBy(F.col(names[0]).alias("_v")).agg(*wanted).withColumn("_s", all_top).join(site_cells, "_s")
    pairs = _prune(pairs, sizes[0])
    for above, here, size in zip(names, names[1:], sizes[1:]):
        v_cells = placed.groupBy(F.col(above).alias("_v"), F.col(here).alias("_v2")).agg(*wanted)
        s_cells = depots.groupBy(F.col(above).alias("_s"), F.col(here).alias("_s2")).agg(latest)
        finer = pairs.join(v_cells, "_v").join(s_cells, "_s")
        pairs = _prune(finer.select(F.col("_v2").alias("_v"), F.col("_s2").alias("_s"), "_first", "_last", "_cutoff"), size)
    nearby = pairs.join(
        depots.select(F.col(names[-1]).alias("_s"), "depot_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "cutoff"), "_s"
    ).select(F.col("_v").alias(names[-1]), "depot_id", "_lat", "_lon", "cutoff")
    choices = placed.join(nearby, names[-1]).filter(F.col("cutoff") >= F.col("_o"))
    choices = choices.withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    first = Window.partitionBy(key).orderBy(F.round("distance_km", _DIGITS), "depot_id")  # group limit 1 before the shuffle
    return choices.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").select(
        *points.columns, "depot_id", "distance_km"
    )


def nearest_depot(vehicles: DataFrame, depots: DataFrame, key: str = "vehicle_id", least_cells: int = 0) -> DataFrame:
    """Per vehicle the nearest depot with a free bay; vehicles drop out when every depot is full.

    Equal distances go to the lowest depot id. Depots on one spot are folded to that id first. Cells are refined until
    they outnumber the depots and ``least_cells`` (for depots that crowd in a few places); the result is the same.
    """
    free = depots.filter(F.col("free_bays") > 0)
    sites = free.groupBy("lat", "lon").agg(F.min("depot_id").alias("depot_id")).withColumn("cutoff", F.lit(_OPEN))
    return _nearest(vehicles.select(key, "lat", "lon"), sites, max(sites.count(), least_cells), key, None)


def live_position(vehicles: DataFrame, twin: DataFrame, depots: DataFrame, key: str = "vin") -> DataFrame:
    """Live position of a vehicle where its twin has one, otherwise its home depot's."""
    live = twin.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    home = depots.select("depot_id", F.col("lat").alias("_home_lat"), F.col("lon").alias("_home_lon"))
    return (
        vehicles.drop("lat", "lon").join(live, key, "left").join(home, "depot_id", "left")
        .withColumn("lat", F.coalesce("_lat", "_home_lat")).withColumn("lon", F.coalesce("_lon", "_home_lon"))
        .drop("_lat", "_lon", "_home_lat", "_home_lon")
    )


def _ranked(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``_rank``, the place of a row among those of its key by ``order``; rows meet per (key, ``_chunk``) only."""
    before = carried(rows, keys, "_chunk", {"_before": (F.count(F.lit(1)), "sum")})
    inside = rows.withColumn("_place", F.row_number().over(chunk_window(keys, "_chunk", [F.col(order)])))
    return inside.join(before, [*keys, "_chunk"]).withColumn(
        "_rank", F.col("_place") + F.coalesce(F.col("_before"), F.lit(0))
    ).drop("_place", "_before")


def _unit(lat, lon) -> np.ndarray:
    """Points on the unit sphere, one row each."""
    lat, lon = np.radians(np.asarray(lat, dtype=float)), np.radians(np.asarray(lon, dtype=float))
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def _km(lat, lon, lats, lons) -> np.ndarray:
    """``haversine_km`` in NumPy."""
    half_lat, half_lon = np.radians(lats - lat) / 2, np.radians(lons - lon) / 2
    h = np.sin(half_lat) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * np.sin(half_lon) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


@dataclass
class _Boxes:
    """The depots of each region lie in its box (corners on the unit sphere's axes); ``latest`` is the last request that any
    of them may still take."""

    low: np.ndarray
    high: np.ndarray
    latest: np.ndarray

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """Per point and region the least chord to a depot there."""
        points = points[:, None, :]
        return np.sqrt((np.maximum(np.maximum(self.low - points, points - self.high), 0) ** 2).sum(axis=2))

    def farthest(self, points: np.ndarray) -> np.ndarray:
        points = points[:, None, :]
        return np.sqrt((np.maximum(abs(self.low - points), abs(points - self.high)) ** 2).sum(axis=2))


class _Region:
    """The depots of a region with the requests that they hold."""

    def __init__(self, frame: pd.DataFrame):
        depots = frame[frame["kind"] == _DEPOT].sort_values("depot_id")
        self.ids, self.lat, self.lon = (depots[c].to_numpy() for c in ("depot_id", "lat", "lon"))
        self.bays = depots["bays"].tolist()
        self.x, self.y, self.z = _unit(self.lat, self.lon).T.copy()
        self.held: list[list[tuple]] = [[] for _ in self.bays]
        self.cutoff = np.full(len(depots), _OPEN, dtype=np.int64)
        place = {d: i for i, d in enumerate(self.ids.tolist())}
        held = frame[frame["kind"] == _HELD]
        for request in zip(held["o"].tolist(), held["lat"].tolist(), held["lon"].tolist(), held["depot_id"].tolist()):
            self.take(place[request[3]], request[:3])
        self.place = place

    def take(self, depot: int, request: tuple) -> tuple | None:
        """Holds the request; the latest one if there are more than bays is returned."""
        held, displaced = self.held[depot], None
        heapq.heappush(held, (-request[0], request))
        if len(held) > self.bays[depot]:
            displaced = heapq.heappop(held)[1]
        if len(held) == self.bays[depot]:
            self.cutoff[depot] = -held[0][0]
        return displaced

    def nearest(self, request: tuple, point: np.ndarray) -> tuple[int | None, float]:
        """The nearest depot that may take the request, and its chord."""
        o, lat, lon = request
        square = (self.x - point[0]) ** 2 + (self.y - point[1]) ** 2 + (self.z - point[2]) ** 2
        square = np.where(self.cutoff >= o, square, np.inf)
        best = int(square.argmin())
        chord = math.sqrt(square[best])
        if chord == math.inf:
            return None, chord
        near = np.flatnonzero(square <= (chord + _SLACK) ** 2)
        if len(near) > 1:  # in order of depot_id
            best = int(near[np.round(_km(lat, lon, self.lat[near], self.lon[near]), _DIGITS).argmin()])
        return best, chord


def _settle(frame: pd.DataFrame, boxes: _Boxes) -> pd.DataFrame:
    """Books the requests that ask in a region, and those displaced by them, until each has a bay or may be nearer to another
    region's depot that takes it: those are left asking."""
    region, here = _Region(frame), int(frame["region"].iloc[0])
    elsewhere = np.arange(len(boxes.latest)) != here
    chosen = frame[frame["kind"] == _CHOSEN].sort_values("o", ascending=False)
    asking = frame[frame["kind"] == _ASKING].sort_values("o", ascending=False)
    todo = [(r, None) for r in zip(asking["o"].tolist(), asking["lat"].tolist(), asking["lon"].tolist())]
    todo += [(r[:3], region.place[r[3]]) for r in zip(*(chosen[c].tolist() for c in ("o", "lat", "lon", "depot_id")))]
    out, last = [], int(region.cutoff.max())
    while todo:
        request, depot = todo.pop()
        if depot is None or region.cutoff[depot] < request[0]:
            depot, chord, point = None, math.inf, _unit(request[1], request[2])
            if last >= request[0]:
                depot, chord = region.nearest(request, point)
                if depot is None:
                    last = int(region.cutoff.max())
            others = elsewhere & (boxes.latest >= request[0])
            if others.any() and boxes.nearest(point[None])[0, others].min() <= chord + _SLACK:
                out.append((here, _ASKING, *request, -1, 0, chord))
                continue
            if depot is None:
                continue  # no depot takes it
        displaced = region.take(depot, request)
        if displaced:
            todo.append((displaced, None))
    ids = region.ids.tolist()
    out += [(here, _HELD, *request, ids[i], 0, 0.0) for i, held in enumerate(region.held) for _, request in held]
    out.append((here, _SUMMARY, int(region.cutoff.max()), 0.0, 0.0, -1, 0, 0.0))
    return pd.DataFrame(out, columns=_ROW_NAMES)


def _settled(boxes: _Boxes):
    return lambda frame: _settle(frame, boxes)


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """For each request that asks in the region the nearest depot there that may take it."""
    region, asking, out = _Region(frame), frame[frame["kind"] == _ASKING], []
    here = int(frame["region"].iloc[0])
    for request in zip(asking["o"].tolist(), asking["lat"].tolist(), asking["lon"].tolist()):
        depot, _ = region.nearest(request, _unit(request[1], request[2]))
        if depot is not None:
            km = _km(request[1], request[2], region.lat[depot], region.lon[depot])
            out.append((here, _CHOSEN, *request, int(region.ids[depot]), 0, float(np.round(km, _DIGITS))))
    return pd.DataFrame(out, columns=_ROW_NAMES).astype({"region": "int32", "kind": "int32", "o": "int64", "depot_id": "int64", "bays": "int64"})


def _in_regions(depots: DataFrame, n: int, per_region: int) -> DataFrame:
    """Adds ``region``: parallels, then meridians between them, part the depots into about equal numbers."""
    bands = math.ceil(math.sqrt(-(-n // per_region)))
    if bands == 1:
        return depots.withColumn("region", F.lit(0))
    parts = -(-n // (per_region * bands))

    def part(value: str, cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c < F.col(value)))

    def shares(k: int) -> list[float]:
        return [i / k for i in range(1, k)]

    parallels = depots.agg(F.percentile_approx("lat", shares(bands)).alias("c")).first()["c"]
    banded = depots.withColumn("_band", part("lat", F.lit(parallels)))
    if parts == 1:
        return banded.withColumnRenamed("_band", "region")
    meridians = banded.groupBy("_band").agg(F.percentile_approx("lon", shares(parts)).alias("_cuts"))
    numbered = banded.join(meridians, "_band").withColumn("_r", F.col("_band") * parts + part("lon", F.col("_cuts")))
    names = {r["_r"]: i for i, r in enumerate(numbered.select("_r").distinct().orderBy("_r").collect())}  # one row per region
    number = F.element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), F.col("_r"))
    return numbered.withColumn("region", number).drop("_band", "_cuts", "_r")


def assign_bays(requests: DataFrame, depots: DataFrame, order: str, order_chunk: Column, per_region: int = DEPOTS_PER_REGION) -> DataFrame:
    """Books requests as if handled one by one in ``order``, each at the nearest depot with a bay left.

    Every request takes a bay while any is left, so exactly the first "total free bays" requests are placed. A depot keeps
    the earliest of the requests that come to it, as many as it has bays; once full, the last one kept is its cutoff, and
    only earlier requests displace one. Cutoffs never rise, so requests may come in any order and the result is that
    of booking one by one. Depots lie in regions of about ``per_region``. One task settles all the requests of a region, as
    long as no depot of another region can be nearer; the others ask the regions in question and come again with
    the best answer. Rounds grow with the regions that displaced requests cross, not with depots. ``order`` is a whole
    number, unique per request; requests without it or without a place are not booked, and unplaced ones are not
    returned. Needs a checkpoint folder: each round's state is written there.
    """
    free = depots.filter((F.col("free_bays") > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    free = free.select(*[F.col(c).cast(t).alias(c) for c, t in (("depot_id", "long"), ("lat", "double"), ("lon", "double"), ("free_bays", "long"))]).checkpoint()
    sites = _in_regions(free, free.count(), per_region).checkpoint()
    axes = {"x": F.cos(F.radians("lat")) * F.cos(F.radians("lon")), "y": F.cos(F.radians("lat")) * F.sin(F.radians("lon")), "z": F.sin(F.radians("lat"))}
    ends = [f(c).alias(f"{n}_{a}") for n, f in (("low", F.min), ("high", F.max)) for a, c in axes.items()]
    found = sites.groupBy("region").agg(F.sum("free_bays").alias("bays"), *ends).orderBy("region").collect()  # one row per region
    result = StructType([StructField(order, requests.schema[order].dataType), StructField("depot_id", depots.schema["depot_id"].dataType), StructField("distance_km", DoubleType())])
    if not found:
        return requests.sparkSession.createDataFrame([], result)
    low, high = (np.array([[r[f"{n}_{a}"] for a in axes] for r in found]) for n in ("low", "high"))
    boxes = _Boxes(low, high, np.full(len(found), _OPEN, dtype=np.int64))
    usable = requests.select(order, "lat", "lon").dropna().withColumn("_chunk", order_chunk)
    first = _ranked(usable, [], order).filter(F.col("_rank") <= sum(r["bays"] for r in found))

    @F.pandas_udf("int")
    def home(lat: pd.Series, lon: pd.Series) -> pd.Series:
        return pd.Series(boxes.nearest(_unit(lat, lon)).argmin(axis=1).astype(np.int32))

    def rows(df: DataFrame, region, kind: int, **columns: Column) -> DataFrame:
        given = {"region": region, "kind": F.lit(kind), "o": F.lit(0), "lat": F.col("lat"), "lon": F.col("lon"), "depot_id": F.lit(-1), "bays": F.lit(0), "chord": F.lit(0.0)} | columns
        return df.select(*[given[n].cast(t).alias(n) for n, t in _ROW])

    stands = rows(sites, F.col("region"), _DEPOT, depot_id=F.col("depot_id"), bays=F.col("free_bays"))
    asking = rows(first, home("lat", "lon"), _ASKING, o=F.col(order))
    known = stands
    while True:
        state = known.unionByName(asking).repartition(len(found), "region").groupBy("region").applyInPandas(_settled(boxes), _ROW_SCHEMA).checkpoint()
        held, left = state.filter(F.col("kind") == _HELD), state.filter(F.col("kind") == _ASKING)
        if left.isEmpty():
            break
        latest = {r["region"]: r["o"] for r in state.filter(F.col("kind") == _SUMMARY).select("region", "o").collect()}  # one row per region
        boxes = _Boxes(low, high, np.array([latest[i] for i in range(len(found))]))
        known = stands.unionByName(held)
        asked = left.withColumn("region", F.explode(_asked(boxes)("o", "lat", "lon", "chord")))
        answers = known.unionByName(asked).repartition(len(found), "region").groupBy("region").applyInPandas(_answer, _ROW_SCHEMA)
        best = answers.groupBy("o").agg(F.min_by(F.struct(*[n for n, _ in _ROW]), F.struct("chord", "depot_id")).alias("_b"))
        asking = best.select("_b.*")
    there = sites.select("depot_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    booked = held.join(there, "depot_id").withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    return booked.select(*[F.col("o" if f.name == order else f.name).cast(f.dataType).alias(f.name) for f in result.fields])


def _asked(boxes: _Boxes):
    """The regions that may hold the nearest depot for a request, given the chord to one that it may have."""

    @F.pandas_udf("array<int>")
    def regions(o: pd.Series, lat: pd.Series, lon: pd.Series, chord: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(o), 1000):
            part = slice(start, start + 1000)
            points = _unit(lat[part], lon[part])
            takes = boxes.latest[None, :] >= o[part].to_numpy()[:, None]
            sure = np.minimum(chord[part].to_numpy(), np.where(takes, boxes.farthest(points), np.inf).min(axis=1))
            out += [np.flatnonzero(row).astype(np.int32) for row in takes & (boxes.nearest(points) <= sure[:, None] + _SLACK)]
        return pd.Series(out, dtype=object)

    return regions
