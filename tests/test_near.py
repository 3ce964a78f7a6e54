import math
import random

from shoebox.functions.geo import EARTH_RADIUS_M, unwrapped_ring
from shoebox.operators.near import covered_cells, inside_places, located, near_and_inside, near_pairs

POINT = "id long, gps_lat double, gps_lon double"
PLACE = "place_id long, ring_lat array<double>, ring_lon array<double>"


def metres(a, b):
    (la, lo), (lb, ob) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def test_near_equals_all_pairs(spark):
    rnd = random.Random(3)
    points = []
    for lat, lon in ((0.001, 0.001), (52.5, 13.4), (-33.8, 180.0), (-33.8, -180.0), (89.9999, 10.0), (-90.0, 0.0)):
        points += [(max(-90.0, min(90.0, lat + rnd.uniform(-0.0015, 0.0015))), (lon + rnd.uniform(-0.002, 0.002) + 180) % 360 - 180) for _ in range(40)]
    points += points[:15]
    got = {(r["id_a"], r["id_b"]) for r in near_pairs(located(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], POINT))).collect()}
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if metres(points[i], points[j]) <= 100}
    assert got == want


def test_bad_locations_repeats_and_empty(spark, rows):
    files = spark.createDataFrame([(1, 10.0, 10.0, 0), (1, 10.0, 10.0, 0), (2, 10.0, 10.0, 0), (3, None, 10.0, 0), (4, 10.0, None, 0), (5, 0.0, 0.0, 0), (6, 91.0, 10.0, 0), (7, float("nan"), 1.0, 0), (None, 10.0, 10.0, 0), (8, 10.0, 180.5, 0)], POINT + ", k int")
    places = spark.createDataFrame([(1, [9.0, 9.0, 11.0, 11.0], [9.0, 11.0, 11.0, 9.0], 0), (2, [1.0, 2.0], [1.0, 2.0], 0), (3, None, None, 0), (4, [9.0, None, 11.0], [9.0, 11.0, 11.0], 0)], PLACE + ", id int")
    assert rows(near_and_inside(files, places)) == [("inside", 1, 1), ("inside", 1, 2), ("near", 1, 2)]
    assert rows(near_and_inside(files.limit(0), places.limit(0))) == []


def test_inside_over_the_date_line_round_the_pole_and_concave(spark, rows):
    points = spark.createDataFrame([(1, 5.0, 179.5), (2, 5.0, -179.5), (3, 5.0, 178.0), (4, 85.0, 77.0), (5, 75.0, 77.0), (6, 1.5, 1.0), (7, 1.0, 2.0), (8, 3.0, 2.0)], "id long, lat double, lon double")
    places = spark.createDataFrame([
        (1, [0.0, 0.0, 10.0, 10.0, 0.0], [179.0, -179.0, -179.0, 179.0, 179.0]),
        (2, [80.0, 80.0, 80.0, 80.0], [0.0, 90.0, 180.0, -90.0]),
        (3, [0.0, 4.0, 4.0, 0.0, 2.0], [0.0, 0.0, 4.0, 4.0, 2.0]),
    ], PLACE)
    # Ring 3 has a notch from its open side down to (2, 2).
    assert rows(inside_places(points, places)) == [(1, 1), (1, 2), (2, 4), (3, 6), (3, 8)]


def test_ring_of_either_direction_is_the_same():
    a = unwrapped_ring([0, 0, 1], [179, -179, -180])
    b = unwrapped_ring([0, 1, 0, 0], [179, 180, -179, 179])
    assert {(x, y % 360) for x, y in a} == {(x, y % 360) for x, y in b}
    assert unwrapped_ring([0, 1], [0, 1]) is None


def test_ring_of_many_corners_is_cut_to_its_cells(spark):
    """A star-like ring of 5 000 corners over a hundred degrees, against the crossing number over all its edges."""
    n, rnd = 5000, random.Random(5)
    turn = [2 * math.pi * i / n for i in range(n)]
    reach = [40 + 8 * math.sin(9 * t) + rnd.uniform(-0.3, 0.3) for t in turn]
    lat, lon = [r * math.sin(t) for r, t in zip(reach, turn)], [150 + r * math.cos(t) for r, t in zip(reach, turn)]
    wrapped = [(x + 180) % 360 - 180 for x in lon]
    cover = covered_cells(spark.createDataFrame([(1, lat, wrapped)], PLACE)).selectExpr("count(*) n", "sum(size(edges)) edges", "max(size(edges)) most").first()
    assert cover["n"] > 5000 and cover["edges"] < 200_000 and cover["most"] < 1000
    points = [(i, rnd.uniform(-60, 60), rnd.uniform(90, 210)) for i in range(3000)] + [(3000 + i, float(rnd.randint(-50, 50)), float(rnd.randint(100, 200))) for i in range(500)]

    def inside(p, x):
        odd = False
        for i in range(n):
            (a1, o1), (a2, o2) = (lat[i], lon[i]), (lat[(i + 1) % n], lon[(i + 1) % n])
            if (a1 > p) != (a2 > p) and x < o1 + (p - a1) / (a2 - a1) * (o2 - o1):
                odd = not odd
        return odd

    df = spark.createDataFrame([(i, p, (x + 180) % 360 - 180) for i, p, x in points], "id long, lat double, lon double")
    assert {r["id"] for r in inside_places(df, spark.createDataFrame([(1, lat, wrapped)], PLACE)).collect()} == {i for i, p, x in points if inside(p, x)}
