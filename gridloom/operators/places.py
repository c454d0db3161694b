"""Nearest places on a sphere, by cells of a grid and rings of neighbouring cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import haversine_km
from gridloom.sources.work import written

#: Places whose full table of distances may be made.
MOST_PLACES = 5_000


def on_sphere(places: DataFrame) -> DataFrame:
    """place, lat, lon, x, y, z on the unit sphere; places without coordinates have no neighbours and go."""
    lat, lon = F.radians("lat"), F.radians("lon")
    known = places.filter(F.col("place").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return known.select("place", "lat", "lon", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))


def nearest(places: DataFrame, k: int, side: float | None = None) -> DataFrame:
    """place, rank from 1, neighbour, km: the k nearest other places of each by great-circle distance, ties by name.

    The unit sphere lies in cubes. A place meets those in its own cube and the 26 around it; what lies outside is at least
    the side of a cube away, so a place is done when its k-th neighbour is nearer than that. The others, sparse ones, try
    again with cubes of twice the side, until one covers the sphere. `side` is that of the first cubes; by default, cubes
    hold about k places if these were spread evenly.
    """
    points = written(on_sphere(places), "places")
    n = points.count()
    side = side or math.sqrt(4 * math.pi * k / max(n, 1))
    cell = lambda c, s: F.floor(F.col(c) / s).cast("long")
    around = F.sequence(F.lit(-1), F.lit(1))
    asking, done = points, []
    while True:
        whole = side >= 2
        own = points.select(*[cell(c, side).alias(f"_{c}") for c in "xyz"], F.col("place").alias("neighbour"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
        asked = asking
        for c in "xyz":
            asked = asked.withColumn("_step", F.explode(around)).withColumn(f"_{c}", cell(c, side) + F.col("_step")).drop("_step")
        met = asked.join(own, ["_x", "_y", "_z"]).filter(F.col("place") != F.col("neighbour"))
        met = met.select("place", "neighbour", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km"))
        found = met.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy("km", "neighbour"))).filter(F.col("rank") <= k)
        if whole:
            done.append(found)
            break
        found = written(found, "places-near")
        # The arc of a chord as long as a side, in km; what is outside of the ring is no nearer.
        reach = haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(math.degrees(2 * math.asin(min(1.0, side / 2)))))
        sure = found.filter((F.col("rank") == k) & (F.col("km") < reach)).select("place")
        done.append(found.join(sure, "place", "left_semi"))
        asking = written(asking.join(sure, "place", "left_anti"), "places-asking")
        if asking.isEmpty():
            break
        side *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("place", "rank", "neighbour", "km")


def distances(places: DataFrame) -> DataFrame:
    """source, target, km of every ordered pair of different places: all pairs, so their number is checked first."""
    if places.limit(MOST_PLACES + 1).count() > MOST_PLACES:
        raise ValueError(f"a table of all distances is for {MOST_PLACES} places at most; `nearest` has no such bound")
    a = places.select(F.col("place").alias("source"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = places.select(F.col("place").alias("target"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    near = a.join(F.broadcast(b), F.col("source") != F.col("target"))
    return near.select("source", "target", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))


def edge_distances(edges: DataFrame, places: DataFrame) -> DataFrame:
    """`edges` (source, target, ...) between different places, with km, by an equi-join for each end."""
    ends = {end: places.select(F.col("place").alias(end), F.col("lat").alias(f"_lat_{end}"), F.col("lon").alias(f"_lon_{end}")) for end in ("source", "target")}
    rows = edges.filter(F.col("source") != F.col("target")).join(ends["source"], "source").join(ends["target"], "target")
    km = haversine_km(F.col("_lat_source"), F.col("_lon_source"), F.col("_lat_target"), F.col("_lon_target"))
    return rows.withColumn("km", km).drop(*[f"_{c}_{end}" for c in ("lat", "lon") for end in ends])
