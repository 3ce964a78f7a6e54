"""SQL for DuckDB that gives the results of the queries by plainer ways."""

from __future__ import annotations


def _hash(c: str) -> str:
    bare = f"lower(regexp_replace({c}, '\\s', '', 'g'))"
    digits = f"regexp_extract({bare}, '^(0x)?0*([0-9a-f]{{1,16}})$', 2)"
    return f"CASE WHEN {digits} NOT IN ('', '0') THEN ('0x' || {digits})::UBIGINT END"


def _sum(c: str, kind: str, size: int, empty: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '\\s', '', 'g'), '^{kind}:', '')"
    hexed = f"CASE WHEN regexp_matches({bare}, '^[0-9A-Fa-f]{{{2 * size}}}$') THEN lower({bare}) WHEN regexp_matches({bare}, '^[A-Za-z0-9+/]+={{1,2}}$') THEN lower(hex(from_base64({bare}))) END"
    return f"CASE WHEN {hexed} NOT IN ('{'0' * 2 * size}', '{empty}') THEN {hexed} END"


_MD5 = _sum("md5", "md5", 16, "d41d8cd98f00b204e9800998ecf8427e")
_SHA = _sum("sha256", "sha256", 32, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")

_RUNS = f"""
WITH f AS (SELECT file_id, t, id, {_hash('phash')} h FROM video_frames WHERE t IS NOT NULL AND file_id IS NOT NULL),
k AS (SELECT * FROM f WHERE h IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, t ORDER BY id) = 1),
g AS (SELECT *, CASE WHEN bit_count(xor(h, lag(h) OVER (PARTITION BY file_id ORDER BY t))::BIT) > 4 THEN 1 ELSE 0 END flag FROM k),
r AS (SELECT *, sum(flag) OVER (PARTITION BY file_id ORDER BY t) run FROM g)
"""

_COMPARABLE = "len(vec) = {dim} AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"

ORACLES = {
    "p1_found": f"""
WITH RECURSIVE v AS (SELECT id, vec::DOUBLE[] v FROM faces WHERE person_id IS NULL AND {_COMPARABLE.format(dim=128)}),
e AS (SELECT a.id a, b.id b FROM v a JOIN v b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.65),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT least(min(b), a) cluster_key, a face_id FROM reach GROUP BY a
""",
    "p7_found": f"""
WITH v AS (SELECT file_id, vec::DOUBLE[] v FROM file_embeddings WHERE {_COMPARABLE.format(dim=64)}),
s AS (SELECT a.file_id a, b.file_id b, round(list_cosine_similarity(a.v, b.v), 7) s FROM v a JOIN v b ON a.file_id <> b.file_id),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) file_id_a, greatest(a, b) file_id_b FROM k WHERE s >= 0.85
""",
    "p3_found": f"""
WITH RECURSIVE h AS (SELECT id, {_hash('phash')} h FROM files),
e AS (
  SELECT file_id_a a, file_id_b b FROM match_pairs WHERE is_match AND file_id_a IS NOT NULL AND file_id_b IS NOT NULL
  UNION SELECT x.file_id, y.file_id FROM dup_members x JOIN dup_members y USING (group_id) WHERE x.file_id IS NOT NULL AND y.file_id IS NOT NULL
  UNION SELECT x.id, y.id FROM h x JOIN h y ON x.id < y.id AND bit_count(xor(x.h, y.h)::BIT) <= 7),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a)
SELECT least(min(b), a) group_key, a file_id FROM reach GROUP BY a
""",
    "p4_found": _RUNS + "SELECT file_id, first(id ORDER BY t) first_frame_id, last(id ORDER BY t) last_frame_id, count(*) n_frames FROM r GROUP BY file_id, run HAVING count(*) > 1",
    "p4_runs": _RUNS + """SELECT file_id, first(id ORDER BY t) first_frame_id, last(id ORDER BY t) last_frame_id, count(*) n_frames,
       min(t) t_first, max(t) t_last, max(t) - min(t) duration FROM r GROUP BY file_id, run HAVING count(*) > 1""",
    "p6_found": f"""
WITH s AS (SELECT id, {_hash('phash')} h, {_MD5} m, {_SHA} s, false new FROM files
           UNION ALL SELECT id, {_hash('phash')}, {_MD5}, {_SHA}, true FROM listing)
SELECT a.id id_a, b.id id_b FROM s a JOIN s b ON b.new AND a.id < b.id AND (a.m = b.m OR a.s = b.s OR bit_count(xor(a.h, b.h)::BIT) <= 7)
GROUP BY 1, 2
""",
}
