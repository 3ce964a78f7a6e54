"""Points near other points, and points in regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.geo import cell_key, cell_of, great_circle_m, half_neighbourhood, unwrapped_ring, valid_location
from shoebox.scratch import materialise

BROADCAST_BYTES = 64 << 20


def located(files: DataFrame, lat: str = "gps_lat", lon: str = "gps_lon", id_: str = "id") -> DataFrame:
    """(id, lat, lon) of the rows with a possible location; -0.0 and 0.0, 180 and -180 are one value."""
    plus = lambda c: F.col(c).cast("double") + F.lit(0.0)
    out = files.select(F.col(id_).alias("id"), plus(lat).alias("lat"), plus(lon).alias("lon")).where(F.col("id").isNotNull())
    return out.where(valid_location(F.col("lat"), F.col("lon"))).withColumn("lon", F.when(F.col("lon") == -180, 180.0).otherwise(F.col("lon")))


def near_places(points: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """(lat_a, lon_a, lat_b, lon_b, metres): pairs of places at most ``radius_m`` apart, each once, a place with itself too.

    A place is one pair of coordinates, however many ids share it; ``points`` says who does. Places go to cubes as wide as
    the radius; each cube meets itself and half of its neighbours in an equi-join, which AQE splits where a cube is hot.
    """
    cell = lambda d, r: d.withColumns(dict(zip(("cx", "cy", "cz"), cell_of(F.col("lat"), F.col("lon"), r))))
    spots = materialise(cell(points.select("lat", "lon").distinct(), radius_m), "spots")
    steps = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip("xyz", s)], F.lit(s == (0, 0, 0)).alias("own")) for s in half_neighbourhood()])
    a = spots.withColumn("s", F.explode(steps)).select(
        F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("s.own").alias("own"),
        cell_key([F.col("cx") + F.col("s.x"), F.col("cy") + F.col("s.y"), F.col("cz") + F.col("s.z")], radius_m).alias("k"),
    )
    b = spots.select(F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), cell_key([F.col("cx"), F.col("cy"), F.col("cz")], radius_m).alias("k"))
    metres = great_circle_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    # Within one cube each unordered pair once; a place also meets itself there, for the ids that share it.
    once = ~F.col("own") | (F.struct("lat_a", "lon_a") <= F.struct("lat_b", "lon_b"))
    return a.hint("merge").join(b, "k").where(once).withColumn("metres", metres).where(F.col("metres") <= radius_m).drop("k", "own")


def near_pairs(points: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """(id_a, id_b, metres): every pair of different ids at most ``radius_m`` apart, smaller id first.

    ``points`` has id, lat, lon as from :func:`located`. Places are joined (:func:`near_places`) and expanded to ids at the
    end; a pair comes out once even where an id is repeated at one place.
    """
    points = points.select("id", "lat", "lon").distinct()
    met = near_places(points, radius_m)
    side = lambda s: points.select(F.col("id").alias(f"i_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    pairs = met.join(side("a"), ["lat_a", "lon_a"]).join(side("b"), ["lat_b", "lon_b"])
    same_place = (F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") == F.col("lon_b"))
    pairs = pairs.where((F.col("i_a") != F.col("i_b")) & (~same_place | (F.col("i_a") < F.col("i_b"))))
    return pairs.select(F.least("i_a", "i_b").alias("id_a"), F.greatest("i_a", "i_b").alias("id_b"), "metres")


_EDGES = [("a1", pa.float64()), ("o1", pa.float64()), ("a2", pa.float64()), ("o2", pa.float64())]
_COVER = "place_id long, gx long, gy long, col long, west double, east double, odd boolean, edges array<struct<a1:double,o1:double,a2:double,o2:double>>"


def _cells_of(ring: np.ndarray, cell: float) -> Iterator[tuple]:
    """(col, row, odd, edges) of every grid cell of a ring (corners as latitude, unwrapped longitude) that it covers or crosses.

    An edge matters to a cell if it lies in the cell's latitudes and not wholly west of it; edges east of the cell that
    span its latitudes are one crossing for every point and become the parity ``odd``. A cell that no edge comes near lies wholly
    inside or outside: inside it has no edges, outside it is left out.
    """
    a1, o1, a2, o2 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
    south, north, west, east = np.minimum(a1, a2), np.maximum(a1, a2), np.minimum(o1, o2), np.maximum(o1, o2)
    slack = 1e-6
    for y in range(int(south.min() // cell), int(north.max() // cell) + 1):
        low, high = y * cell - slack, (y + 1) * cell + slack
        band = np.flatnonzero((north >= low) & (south <= high))
        for x in range(int(west.min() // cell), int(east.max() // cell) + 1):
            left, right = x * cell - slack, (x + 1) * cell + slack
            here = band[east[band] >= left]
            if not len(here):
                continue
            beyond = west[here] > right
            if beyond.all():
                # No edge near: one point tells for all.
                lat = (low + high) / 2
                if ((a1[here] > lat) != (a2[here] > lat)).sum() % 2:
                    yield x, y, True, here[:0]
                continue
            spans = beyond & (south[here] < low) & (north[here] > high)
            yield x, y, bool(spans.sum() % 2), here[~spans]


def _ring_cells(batches: Iterator[pa.RecordBatch], cell_deg: float) -> Iterator[pa.RecordBatch]:
    per_turn = round(360 / cell_deg)
    names = ["place_id", "gx", "gy", "col", "west", "east", "odd", "edges"]
    kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.bool_(), pa.list_(pa.struct(_EDGES))]
    for batch in batches:
        for place, lat, lon in zip(*(batch.column(c).to_pylist() for c in ("place_id", "ring_lat", "ring_lon"))):
            ring = unwrapped_ring(lat, lon)
            if ring is None:
                continue
            ring = np.array(ring)
            west, east, rows = ring[:, 1].min(), ring[:, 1].max(), []
            for x, y, odd, edges in _cells_of(ring, cell_deg):
                rows.append((place, x % per_turn, y, x, west, east, odd, [{"a1": ring[e, 0], "o1": ring[e, 1], "a2": ring[e + 1, 0], "o2": ring[e + 1, 1]} for e in edges]))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def covered_cells(places: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """The rings of places (place_id, ring_lat, ring_lon) cut into the cells of a grid, as :func:`_cells_of` tells."""
    src = places.select(F.col("place_id").cast("long").alias("place_id"), F.col("ring_lat").cast("array<double>").alias("ring_lat"), F.col("ring_lon").cast("array<double>").alias("ring_lon"))
    return src.where("place_id is not null").distinct().mapInArrow(lambda b: _ring_cells(b, cell_deg), _COVER)


def inside_places(points: DataFrame, places: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """(place_id, id): every place whose ring contains the point.

    Rings are cut into the cells of a grid of ``cell_deg`` (a divisor of 360); points meet the rings of their own cell and are
    tested by crossing number in unwrapped longitudes against the edges that matter there; in a cell wholly inside there are none. Edges are straight in
    latitude and longitude and go the short way over 180 degrees; a point on an edge counts for one side only.
    Rings of fewer than three corners contain nothing. The covered cells are broadcast while their bytes (counted) are few,
    else joined by shuffle.
    """
    cover = materialise(covered_cells(places, cell_deg), "cover")
    per_turn = round(360 / cell_deg)
    p = points.select("id", "lat", "lon").distinct().withColumns({"gx": F.pmod(F.floor(F.col("lon") / cell_deg), F.lit(per_turn)).cast("bigint"), "gy": F.floor(F.col("lat") / cell_deg).cast("bigint")})
    size = cover.agg(F.sum(F.size("edges") * 48 + 96)).first()[0] or 0
    met = p.join(F.broadcast(cover) if size <= BROADCAST_BYTES else cover, ["gx", "gy"])
    # The turn of the globe on which the point can lie between the ring's west and east ends, and the cell of that turn.
    turn = F.col("lon") + 360 * F.ceil((F.col("west") - F.col("lon")) / 360)
    met = met.withColumn("x", turn).where((F.col("x") <= F.col("east")) & (F.abs(F.col("x") / cell_deg - F.col("col") - 0.5) < 0.75))

    def crossed(e):
        up = (e["a1"] > F.col("lat")) != (e["a2"] > F.col("lat"))
        at = e["o1"] + (F.col("lat") - e["a1"]) / F.when(e["a2"] != e["a1"], e["a2"] - e["a1"]) * (e["o2"] - e["o1"])
        return F.coalesce(up & (F.col("x") < at), F.lit(False))

    odd = F.aggregate("edges", F.col("odd"), lambda acc, e: acc != crossed(e))
    return met.where(odd).select("place_id", "id")


def near_and_inside(files: DataFrame, places: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """(kind, id_a, id_b): ``near`` pairs of files, smaller id first, and ``inside`` pairs of place and file."""
    points = materialise(located(files), "located")
    near = near_pairs(points, radius_m).select(F.lit("near").alias("kind"), "id_a", "id_b").distinct()
    inside = inside_places(points, places).select(F.lit("inside").alias("kind"), F.col("place_id").alias("id_a"), F.col("id").alias("id_b")).distinct()
    return near.unionByName(inside)
