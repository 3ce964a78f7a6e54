"""Queries over the general data-preparation operators."""

from __future__ import annotations

from shoebox.operators.near import near_and_inside
from shoebox.operators.timestamps import normalise_times
from shoebox.plans.tables import table


def p2_found(spark, d):
    return normalise_times(table(spark, d, "files"), table(spark, d, "origins"))


def p5_found(spark, d):
    return near_and_inside(table(spark, d, "files"), table(spark, d, "places"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}

_LOCATED = "SELECT id, gps_lat lat, gps_lon lon FROM files WHERE abs(gps_lat) <= 90 AND abs(gps_lon) <= 180 AND NOT (gps_lat = 0 AND gps_lon = 0)"

# Brute force: every pair of locations, every location against every ring.
ORACLES = {
    "p5_found": f"""
WITH RECURSIVE loc AS ({_LOCATED}),
near AS (
  SELECT 'near' kind, a.id id_a, b.id id_b FROM loc a JOIN loc b ON a.id < b.id
  WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 100),
corner AS (SELECT place_id, unnest(generate_series(1, len(ring_lat))) i, len(ring_lat) n, ring_lat, ring_lon FROM places),
edge AS (
  SELECT place_id, i, ring_lat[i] a1, ring_lat[i % n + 1] a2, ring_lon[i] o1,
         ((ring_lon[i % n + 1] - ring_lon[i] + 540) - 360 * floor((ring_lon[i % n + 1] - ring_lon[i] + 540) / 360)) - 180 step FROM corner),
run AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY place_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) walked FROM edge),
ring AS (SELECT place_id, a1, a2, first_o + walked x1, first_o + walked + step x2
         FROM run JOIN (SELECT place_id, ring_lon[1] first_o FROM places) USING (place_id)),
box AS (SELECT place_id, min(least(x1, x2)) west FROM ring GROUP BY 1),
spot AS (SELECT l.id, l.lat, b.place_id, l.lon + 360 * ceil((b.west - l.lon) / 360) x FROM loc l CROSS JOIN box b),
inside AS (
  SELECT 'inside' kind, spot.place_id id_a, spot.id id_b FROM spot JOIN ring r
  ON r.place_id = spot.place_id AND (r.a1 > spot.lat) <> (r.a2 > spot.lat) AND spot.x < r.x1 + (spot.lat - r.a1) / (r.a2 - r.a1) * (r.x2 - r.x1)
  GROUP BY 2, 3 HAVING count(*) % 2 = 1)
SELECT * FROM near UNION ALL SELECT * FROM inside
""",
}
