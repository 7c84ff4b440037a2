"""Zone assignment from a table of boxes (zone, lat/lng ranges, priority)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.functions.geo import NO_COORDINATES, NO_ZONE, ZONE_BOXES
from ridelake.operators.grids import cell_of

ZONE_SCHEMA = "zone string, lat_min double, lat_max double, lng_min double, lng_max double, priority int"
BROADCAST_ZONES = 1_000
#: Cells that a box spans to a side in the grid of its size, at most and besides the one it begins in.
SPAN = 8
_ZONE_FIELDS = ["priority", "zone", "lat_min", "lat_max", "lng_min", "lng_max"]


def zone_table(spark: SparkSession, boxes=ZONE_BOXES) -> DataFrame:
    rows = [(b.zone, b.lat_min, b.lat_max, b.lng_min, b.lng_max, i) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, ZONE_SCHEMA)


def _holds(lat: Column, lng: Column, box) -> Column:
    return lat.between(box("lat_min"), box("lat_max")) & lng.between(box("lng_min"), box("lng_max"))


def _level(zones: DataFrame, cell: float) -> DataFrame:
    """Zones with ``level``: the number of doublings of ``cell`` after which a box spans few cells."""
    size = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lng_max") - F.col("lng_min")) / F.lit(cell * SPAN)
    return zones.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1.0))))).cast("int"))


def _by_cell(zones: DataFrame, cell: float) -> DataFrame:
    """Zones of one level repeated for every grid cell they reach into.

    Division and floor never decrease, so a point inside a box always lies in
    one of the box's cells.
    """
    def span(axis: str) -> Column:
        return F.sequence(cell_of(F.col(f"{axis}_min"), cell), cell_of(F.col(f"{axis}_max"), cell))

    rows = zones.select(*_ZONE_FIELDS, F.explode(span("lat")).alias("cell_lat"))
    return rows.withColumn("cell_lng", F.explode(span("lng")))


def _fallback(lat: Column, lng: Column) -> Column:
    return F.when(lat.isNull() | lng.isNull(), F.lit(NO_COORDINATES)).otherwise(F.lit(NO_ZONE))


def assign_zone(
    df: DataFrame, zones: DataFrame, lat: str, lng: str, out: str, cell: float = 0.05
) -> DataFrame:
    """Add ``out``: the zone of lowest priority number that holds the point.

    Points meet zones by an equality join on a grid cell, never by testing
    every pair. Every box lies in the grid of its size, ``cell`` doubled as often
    as needed, in which it reaches into a few dozen cells however large it is; a
    point is looked up once in each grid in use, at most one for every doubling.
    Whether the zone side is broadcast follows from a count of it: a few zones
    are; else zones and distinct points are shuffled by cell, where adaptive
    execution splits hot cells, and the first zone of a point joins back to
    the rows at that point. Rows are told apart by their point alone, so both
    ways give one answer. A box with a minimum above its maximum holds nothing.
    """
    y, x = F.col(lat), F.col(lng)
    zones = _level(zones.filter("lat_min <= lat_max AND lng_min <= lng_max"), cell)
    sizes = {r["level"]: r["zones"] for r in zones.groupBy("level").agg(F.count(F.lit(1)).alias("zones")).collect()}
    grids = {level: (_by_cell(zones.filter(F.col("level") == level), cell * 2.0**level), cell * 2.0**level) for level in sorted(sizes)}
    cells = ["cell_lat", "cell_lng"]
    columns = [df[c] for c in df.columns if c != out]
    if sum(sizes.values()) <= BROADCAST_ZONES:
        points, found = df, []
        for level, (covered, size) in grids.items():
            found.append(f"_zones_{level}")
            candidates = covered.groupBy(*cells).agg(F.sort_array(F.collect_list(F.struct(*_ZONE_FIELDS))).alias(found[-1]))
            points = points.withColumns({"cell_lat": cell_of(y, size), "cell_lng": cell_of(x, size)})
            points = points.join(F.broadcast(candidates), cells, "left").drop(*cells)
        hits = [F.filter(F.coalesce(c, F.array()), lambda z: _holds(y, x, z.getField)) for c in found]
        best = F.get(F.sort_array(F.concat(*hits)), F.lit(0)).getField("zone") if hits else F.lit(None).cast("string")
        return points.select(*[F.col(c) for c in df.columns if c != out], F.coalesce(best, _fallback(y, x)).alias(out))
    at = [F.col("_lat"), F.col("_lng")]
    places = df.select(y.alias("_lat"), x.alias("_lng")).distinct()
    matches = None
    for covered, size in grids.values():
        placed = places.withColumns({"cell_lat": cell_of(at[0], size), "cell_lng": cell_of(at[1], size)})
        met = placed.join(covered, cells).filter(_holds(*at, F.col)).select(*at, "priority", "zone")
        matches = met if matches is None else matches.unionByName(met)
    matches = matches.groupBy(*at).agg(F.min(F.struct("priority", "zone")).alias("best"))
    matches = matches.select(*at, F.col("best.zone").alias("_zone"))
    return df.join(matches, (df[lat] == F.col("_lat")) & (df[lng] == F.col("_lng")), "left").select(
        *columns, F.coalesce(F.col("_zone"), _fallback(df[lat], df[lng])).alias(out)
    )
