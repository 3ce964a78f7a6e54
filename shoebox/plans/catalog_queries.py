"""Queries over the catalogue's operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import media, names
from shoebox.functions.hashes import byte_chunk, checksum, hamming, phash64
from shoebox.functions.vectors import comparable, cosine, softmax, top_labels
from shoebox.operators import changes, duplicates, frames, listing, reports, trees, vectors
from shoebox.operators.alike import alike_links
from shoebox.operators.components import connected_components
from shoebox.operators.hamming import hamming_join
from shoebox.operators.search import search
from shoebox.plans.tables import table
from shoebox.scratch import materialise, scratch_path
from shoebox.sources import files as source_files
from shoebox.sources import sinks
from shoebox.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return build

    return add


# Parts of the SQL side.
LIVE = "status <> 'trashed'"
SCREEN = ", ".join(f"({w}, {h})" for w, h in media.SCREEN_SIZES)
LABELS = f"""(
  SELECT id file_id, 'screenshot' AS label, CASE WHEN regexp_matches(coalesce(name, ''), '{names.SCREEN_NAME}') THEN 0.97::DOUBLE
      WHEN (coalesce(width, 0), coalesce(height, 0)) IN ({SCREEN}) AND camera IS NULL THEN 0.75
      WHEN mime = 'image/png' AND camera IS NULL AND width > 0 AND height > 0 AND width / height > 0.4 AND width / height < 0.6 THEN 0.6 END score FROM files
  UNION ALL SELECT id, 'messaging_download', CASE WHEN regexp_matches(coalesce(name, ''), '{names.MESSENGER_NAME}') THEN 0.8::DOUBLE END FROM files)"""
LABELS = f"(SELECT * FROM {LABELS} WHERE score IS NOT NULL)"
TOP = "nullif(split_part(path, '/', 1), '')"
PHASH = r"(CASE WHEN regexp_extract(lower(regexp_replace({0}, '\s', '', 'g')), '^(0x)?0*([0-9a-f]{{1,16}})$', 2) NOT IN ('', '0') THEN ('0x' || regexp_extract(lower(regexp_replace({0}, '\s', '', 'g')), '^(0x)?0*([0-9a-f]{{1,16}})$', 2))::UBIGINT END)"


def _sum(col: str, kind: str, size: int, empty: str) -> str:
    bare = f"regexp_replace(regexp_replace({col}, '\\s', '', 'g'), '^{kind}:', '')"
    hexed = f"CASE WHEN regexp_matches({bare}, '^[0-9A-Fa-f]{{{2 * size}}}$') THEN lower({bare}) WHEN regexp_matches({bare}, '^[A-Za-z0-9+/]+={{1,2}}$') THEN lower(hex(from_base64({bare}))) END"
    return f"(CASE WHEN {hexed} NOT IN ('{'0' * 2 * size}', '{empty}') THEN {hexed} END)"


MD5 = _sum("md5", "md5", 16, "d41d8cd98f00b204e9800998ecf8427e")
SHA = _sum("sha256", "sha256", 32, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
KEY = f"coalesce('md5:' || {MD5}, {SHA})"
KEEP = (
    "coalesce(width, 0)::BIGINT * coalesce(height, 0) DESC, round(coalesce(CASE WHEN isnan(quality) THEN 0 ELSE quality END, 0), 2) DESC, coalesce(size, 0) DESC, "
    f"regexp_matches(coalesce(name, ''), '{names.COPY_NAME}') ASC, coalesce(substr(coalesce(taken_time, created_time), 1, 19), '9999') ASC, id ASC"
)
ACTIONS = """(SELECT event_id id, event_id rec_id, user_id file_id, ts executed_at, CASE WHEN event_type = 'signup' THEN ts END undone_at FROM events WHERE event_type IN ('click', 'signup'))"""
REASONS = "(SELECT event_id rec_id, CASE event_id % 3 WHEN 0 THEN 'Screenshots' WHEN 1 THEN 'Documents' ELSE 'Memes' END reason FROM events WHERE event_type = 'click')"
FACES_OK = "len(vec) = 128 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"


def actions_of(t: Tables) -> DataFrame:
    """An audit log in the shape of the catalogue's, from the event table."""
    e = t.events.where("event_type in ('click', 'signup')")
    return e.select(F.col("event_id").alias("id"), F.col("event_id").alias("rec_id"), F.col("user_id").alias("file_id"), F.col("ts").alias("executed_at"), F.when(F.col("event_type") == "signup", F.col("ts")).alias("undone_at"))


def reasons_of(t: Tables) -> DataFrame:
    r = F.col("event_id") % 3
    return t.events.where("event_type = 'click'").select(F.col("event_id").alias("rec_id"), F.when(r == 0, "Screenshots").when(r == 1, "Documents").otherwise("Memes").alias("reason"))


# Scans, filters and projections.
query("S7_scan", "SELECT id, source, name, size FROM files")(lambda t: t.files.select("id", "source", "name", "size"))
query("S14_frame_hashes", f"SELECT file_id, t, id, {PHASH.format('phash')}::HUGEINT::VARCHAR h FROM video_frames WHERE t IS NOT NULL AND {PHASH.format('phash')} IS NOT NULL")(
    lambda t: frames.frame_hashes(t.video_frames).withColumn("h", F.expr("cast(case when h < 0 then cast(h as decimal(20,0)) + 18446744073709551616 else cast(h as decimal(20,0)) end as string)"))
)
query("S15_lookup", "SELECT id, name FROM persons WHERE id = 7")(lambda t: listing.required(listing.lookup(t.persons, "id", 7), "person"))
query("F1_live", f"SELECT id FROM files WHERE {LIVE}")(lambda t: duplicates.live(t.files).select("id"))
query("F2_browse", f"SELECT id, name FROM files WHERE kind = 'photo' AND status = 'analyzed' AND id IN (SELECT file_id FROM {LABELS} WHERE label = 'screenshot')")(
    lambda t: listing.browse(t.files, listing.labels_of(t.files), "photo", "analyzed", "screenshot").select("id", "name")
)
query("F4_J4_keyword", f"SELECT id FROM files WHERE {LIVE} AND (name ILIKE '%scan%' OR id IN (SELECT file_id FROM {LABELS} WHERE label ILIKE '%scan%'))")(
    lambda t: listing.keyword_search(t.files, listing.labels_of(t.files), "scan").select("id")
)
query("F5_folder", f"SELECT id, path FROM files WHERE path ILIKE 'g%/%' AND {LIVE}")(lambda t: listing.folder_files(t.files, "G%/").select("id", "path"))
query("F6_year", "SELECT id FROM files WHERE substr(coalesce(taken_time, created_time), 1, 4) = '2018'")(lambda t: t.files.where(listing.year_text(t.files) == "2018").select("id"))
query("F7_top_folder", f"SELECT DISTINCT {TOP} folder FROM files WHERE {TOP} IS NOT NULL")(lambda t: t.files.select(names.top_folder(F.col("path")).alias("folder")).where("folder is not null").distinct())
query("F8_kind", "SELECT id, CASE WHEN mime LIKE 'video/%' THEN 'video' ELSE 'photo' END kind_of FROM files")(lambda t: t.files.select("id", names.kind_of(F.col("mime")).alias("kind_of")))
_EXT = "lower(regexp_extract(name, '^.*[^/](\\.[^./]+)$', 1))"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
query(
    "F9_category",
    f"SELECT id, CASE WHEN {_EXT} IN ({_IN(names.IMAGE_EXTENSIONS)}) THEN 'photos' WHEN {_EXT} IN ({_IN(names.VIDEO_EXTENSIONS)}) THEN 'videos' WHEN {_EXT} IN ({_IN(names.AUDIO_EXTENSIONS)}) THEN 'audio' ELSE 'other' END category FROM files",
)(lambda t: t.files.select("id", names.category_of(F.col("name")).alias("category")))
query("F11_visible", "SELECT id FROM listing WHERE NOT starts_with(name, '.') AND NOT starts_with(coalesce(mime, ''), 'application/vnd.google-apps')")(
    lambda t: t.listing.where(~F.col("name").startswith(".") & ~F.coalesce("mime", F.lit("")).startswith(names.NATIVE_PREFIX)).select("id")
)
query("F12_size_cap", "SELECT id, CASE WHEN size > 5000000 THEN 'skipped' ELSE 'fetch' END plan FROM files")(lambda t: t.files.select("id", F.when(F.col("size") > 5_000_000, "skipped").otherwise("fetch").alias("plan")))
query("F14_detections", "SELECT id FROM faces WHERE det_score >= 0.5")(lambda t: t.faces.where("det_score >= 0.5").select("id"))

# Joins.
query("J2_live_members", f"""
WITH a AS (SELECT DISTINCT group_id, file_id, similarity, name FROM dup_members JOIN files ON files.id = file_id WHERE {LIVE})
SELECT * FROM a WHERE group_id IN (SELECT group_id FROM a GROUP BY 1 HAVING count(DISTINCT file_id) >= 2)""")(lambda t: listing.live_members(t.dup_members, t.files).select("group_id", "file_id", "similarity", "name"))
query("J3_faces_persons", "SELECT f.id, f.file_id, p.name FROM faces f LEFT JOIN persons p ON p.id = f.person_id")(
    lambda t: t.faces.select("id", "file_id", "person_id").join(t.persons.select(F.col("id").alias("person_id"), "name"), "person_id", "left").select("id", "file_id", "name")
)
query("J5_folder_people", f"""
SELECT {TOP} folder, p.id person_id, count(*) n_faces, count(DISTINCT f.file_id) n_files, min(f.id) sample_face_id, p.name
FROM persons p JOIN faces f ON f.person_id = p.id JOIN files ON files.id = f.file_id WHERE {LIVE} AND {TOP} IS NOT NULL GROUP BY ALL""")(
    lambda t: reports.folder_people(t.files, t.faces, t.persons).select("folder", "person_id", "n_faces", "n_files", "sample_face_id", "name")
)
query("F10_J6_undecided", "SELECT id FROM files WHERE NOT EXISTS (SELECT 1 FROM dup_members d WHERE d.file_id = files.id)")(
    lambda t: t.files.select("id").join(t.dup_members.select(F.col("file_id").alias("id")), "id", "left_anti")
)
query("J7_without_faces", "SELECT id FROM files WHERE NOT EXISTS (SELECT 1 FROM faces f WHERE f.file_id = files.id)")(lambda t: listing.without_faces(t.files.select("id"), t.faces))
query("J8_with_persons", "SELECT id FROM files WHERE id IN (SELECT file_id FROM faces WHERE person_id IN (1, 2, 17))")(lambda t: listing.with_persons(t.files, t.faces, [1, 2, 17]).select("id"))
query("J9_person_and_year", "SELECT id FROM files WHERE id IN (SELECT file_id FROM faces WHERE person_id IN (17)) AND substr(coalesce(taken_time, created_time), 1, 4) = '2018'")(
    lambda t: listing.with_persons(t.files, t.faces, [17]).select("id").intersect(t.files.where(listing.year_text(t.files) == "2018").select("id"))
)


@query("J10_close_hashes", f"""
WITH h AS (SELECT DISTINCT {PHASH.format('phash')} h FROM files), g AS (SELECT h FROM h WHERE h IS NOT NULL)
SELECT a.h::VARCHAR low, b.h::VARCHAR high, bit_count(xor(a.h, b.h)::BIT)::INTEGER distance FROM g a JOIN g b ON a.h < b.h AND bit_count(xor(a.h, b.h)::BIT) <= 7""")
def _close_hashes(t):
    h = materialise(t.files.select(phash64(F.col("phash")).alias("h")).where("h is not null").distinct(), "hashes")
    big = lambda c: F.expr(f"case when {c} < 0 then cast({c} as decimal(20,0)) + 18446744073709551616 else cast({c} as decimal(20,0)) end")
    met = hamming_join(h, h, 7, same=True).select(big("h_a").alias("a"), big("h_b").alias("b"), "distance")
    return met.select(F.least("a", "b").cast("string").alias("low"), F.greatest("a", "b").cast("string").alias("high"), "distance")


_OVERLAP = f"""
f AS (SELECT file_id id, {PHASH.format('phash')} h, video_frames.id frame FROM video_frames WHERE {PHASH.format('phash')} IS NOT NULL AND file_id IN (<videos>)),
l AS (SELECT id, count(*) len FROM f GROUP BY 1),
x AS (SELECT DISTINCT a.id a, b.id b, a.frame FROM f a JOIN f b ON a.id <> b.id AND bit_count(xor(a.h, b.h)::BIT) <= 8),
o AS (SELECT x.a s, x.b l, count(*) / any_value(p.len) overlap FROM x JOIN l p ON p.id = x.a JOIN l q ON q.id = x.b WHERE p.len < q.len OR p.len = q.len AND x.a < x.b GROUP BY x.a, x.b)"""
# Each video once more under its negative id, as a copy of other bytes that lost the frames without sharpness.
_CLIPS = "clips AS (SELECT file_id, id, phash FROM video_frames UNION ALL SELECT -file_id, -id, phash FROM video_frames WHERE sharpness IS NOT NULL)"
_FILMS = "films AS (SELECT * FROM files UNION ALL SELECT * REPLACE (-id AS id, NULL AS md5, NULL AS sha256) FROM files)"


def _clips(t):
    f = t.video_frames.select("file_id", "id", "phash", "sharpness")
    return f.unionByName(f.where("sharpness is not null").withColumns({"file_id": -F.col("file_id"), "id": -F.col("id")}))


def _films(t):
    none = F.lit(None).cast("string")
    return t.files.unionByName(t.files.withColumns({"id": -F.col("id"), "md5": none, "sha256": none}))


query("J11_video_overlap", f"WITH {_CLIPS}, {_OVERLAP.replace('<videos>', 'SELECT id FROM files UNION ALL SELECT -id FROM files').replace('video_frames', 'clips')} SELECT least(s, l) a, greatest(s, l) b, round(overlap, 6) overlap FROM o WHERE overlap >= 0.7")(
    lambda t: duplicates.video_overlaps(_clips(t), _films(t).select("id")).withColumn("overlap", F.round("overlap", 6))
)
query("J12_R15_assign", f"""
WITH v AS (SELECT id, person_id, list_transform(vec::DOUBLE[], lambda x: x / sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[]))) u FROM faces WHERE {FACES_OK}),
e AS (SELECT person_id, unnest(u) x, generate_subscripts(u, 1) i FROM v WHERE person_id IS NOT NULL),
m AS (SELECT person_id, i, avg(x) x FROM e GROUP BY 1, 2), c AS (SELECT person_id, list(x ORDER BY i) m FROM m GROUP BY 1),
s AS (SELECT v.id, c.person_id, round(round(list_cosine_similarity(v.u, c.m), 9), 6) s FROM v CROSS JOIN c WHERE v.person_id IS NULL)
SELECT id, person_id, s similarity FROM s WHERE s > 0.25 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, person_id) = 1""")(
    lambda t: vectors.assign_to_centroids(t.faces.where("person_id is null"), vectors.centroids(t.faces, "person_id"), "person_id", 0.25).withColumn("similarity", F.round("similarity", 6)).select("id", "person_id", "similarity")
)
_UNIT = "list_transform(vec::DOUBLE[], lambda x: x / sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])))"
query("J13_exemplars", f"""
WITH v AS (SELECT id, person_id, {_UNIT} u FROM faces WHERE {FACES_OK})
SELECT a.id, round(round(greatest(max(list_dot_product(a.u, b.u)), 0), 9), 6) similarity FROM v a CROSS JOIN v b WHERE b.person_id IN (1, 2) GROUP BY a.id""")(
    lambda t: vectors.exemplar_similarity(t.faces, t.faces.where("person_id in (1, 2)")).withColumn("similarity", F.round("similarity", 6))
)
_ONES = [1.0 if i % 2 else -0.5 for i in range(64)]
query("J14_K3_vector_top_k", f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(v, {_ONES}::DOUBLE[]), 3) score FROM v ORDER BY round(list_cosine_similarity(v, {_ONES}::DOUBLE[]), 9) DESC, vec_id LIMIT 20""")(
    lambda t: vectors.top_k(t.embeddings, _ONES, 20, "vec_id", "embedding")
)
query("J15_hydrate", f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), k AS (SELECT vec_id, round(list_cosine_similarity(v, {_ONES}::DOUBLE[]), 3) score FROM v ORDER BY round(list_cosine_similarity(v, {_ONES}::DOUBLE[]), 9) DESC, vec_id LIMIT 20)
SELECT vec_id, score, label FROM k JOIN embeddings USING (vec_id)""")(
    lambda t: listing.hydrate(vectors.top_k(t.embeddings, _ONES, 20, "vec_id", "embedding").withColumnRenamed("vec_id", "file_id"), t.embeddings.withColumnRenamed("vec_id", "id"), ["label"]).select(F.col("file_id").alias("vec_id"), "score", "label")
)
query("J16_transfer_plan", f"""
WITH l AS (SELECT id, {MD5} m FROM listing), k AS (SELECT DISTINCT {MD5} m FROM files)
SELECT id, m IS NULL OR (m NOT IN (SELECT m FROM k WHERE m IS NOT NULL) AND id = min(id) OVER (PARTITION BY m)) fetched FROM l""")(
    lambda t: changes.transfer_plan(t.listing.select("id", checksum(F.col("md5"), "md5").alias("md5")), t.files.select(checksum(F.col("md5"), "md5").alias("md5"))).select("id", F.col("fetch").alias("fetched"))
)
_REGISTER = f"""
SELECT f.id file_id, a.executed_at, coalesce(r.reason, 'manual') reason, f.size, f.md5 FROM files f
LEFT JOIN (SELECT file_id, max(id) id, max_by(executed_at, id) executed_at FROM {ACTIONS} WHERE undone_at IS NULL GROUP BY 1) a ON a.file_id = f.id
LEFT JOIN {REASONS} r ON r.rec_id = a.id WHERE f.status = 'trashed'"""
query("J17_A20_register", f"SELECT file_id, executed_at, reason FROM ({_REGISTER})")(lambda t: reports.trashed_register(t.files, actions_of(t), reasons_of(t)).select("file_id", "executed_at", "reason"))
query("J18_face_counts", "SELECT id, (SELECT count(*) FROM faces WHERE file_id = files.id) n_faces FROM files")(
    lambda t: t.files.select("id").join(t.faces.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n_faces")), "id", "left").select("id", F.coalesce("n_faces", F.lit(0)).alias("n_faces"))
)

# Upserts and replacements.
_NEW = "(SELECT * FROM listing QUALIFY row_number() OVER (PARTITION BY source, path ORDER BY id DESC) = 1)"
query("U1_upsert", f"""
SELECT f.id, coalesce(f.source, n.source) AS source, coalesce(f.path, n.path) path, CASE WHEN n.id IS NULL THEN f.size ELSE n.size END size, coalesce(n.md5, f.md5) md5, f.status
FROM files f FULL JOIN {_NEW} n ON f.source = n.source AND f.path = n.path""")(
    lambda t: changes.upsert_index(t.files.select("id", "source", "path", "size", "md5", "status"), t.listing.select(F.col("id").alias("seq"), "source", "path", "size", "md5"), ["source", "path"], ["size"], ["md5"])
)
query("U2_merge_labels", """
WITH a AS (SELECT file_id, 'face' AS label, det_score score, 'photo' AS method, 0 seq FROM faces WHERE frame_time IS NULL OR isnan(frame_time)
           UNION ALL SELECT file_id, 'face', det_score, 'frame', 1 FROM faces WHERE NOT (frame_time IS NULL OR isnan(frame_time)))
SELECT file_id, label, round(max(score), 3) score, max_by(method, seq) AS method FROM a GROUP BY 1, 2""")(
    lambda t: changes.merge_labels(*[t.faces.where(c).select("file_id", F.lit("face").alias("label"), F.col("det_score").alias("score"), F.lit(m).alias("method")) for c, m in (("frame_time is null or isnan(frame_time)", "photo"), ("not (frame_time is null or isnan(frame_time))", "frame"))])
)
query("U3_last_wins", "SELECT file_id, t, id, phash FROM video_frames QUALIFY row_number() OVER (PARTITION BY file_id, t ORDER BY id DESC) = 1")(lambda t: changes.last_wins(t.video_frames.select("file_id", "t", "id", "phash"), ["file_id", "t"], "id"))
query("U5_replace", """
SELECT group_id, file_id FROM dup_members WHERE NOT EXISTS (SELECT 1 FROM match_pairs m WHERE m.is_match AND m.file_id_a = file_id)
UNION ALL SELECT -pair_id, file_id_a FROM match_pairs WHERE is_match""")(
    lambda t: changes.replace_rows(t.dup_members.select("group_id", "file_id"), t.match_pairs.where("is_match").select((-F.col("pair_id")).alias("group_id"), F.col("file_id_a").alias("file_id")), ["file_id"])
)
query("U6_id_union", "SELECT file_id FROM dup_members UNION SELECT file_id_a FROM match_pairs UNION SELECT file_id FROM faces")(
    lambda t: changes.id_union(t.dup_members.select("file_id"), t.match_pairs.select(F.col("file_id_a").alias("file_id")), t.faces.select("file_id"))
)
query("U7_append", "SELECT group_id, file_id, round(similarity, 3) similarity FROM dup_members UNION ALL SELECT -1, id, round(quality, 3) FROM files WHERE quality < 0.25")(
    lambda t: t.dup_members.select("group_id", "file_id", F.round("similarity", 3).alias("similarity")).unionByName(t.files.where("quality < 0.25 and not isnan(quality)").select(F.lit(-1).cast("bigint").alias("group_id"), F.col("id").alias("file_id"), F.round("quality", 3).alias("similarity")))
)

# Aggregates.
query("A1_overview", "SELECT count(*) total, count(*) FILTER (kind = 'photo') photos, count(*) FILTER (kind = 'video') videos, count(*) FILTER (status = 'analyzed') analyzed, count(*) FILTER (status = 'error') errors, count(*) FILTER (status = 'trashed') trashed FROM files")(
    lambda t: reports.overview(t.files)
)
query("A2_counts_by_key", "SELECT event_type, count(*) n FROM events GROUP BY 1")(lambda t: t.events.groupBy("event_type").agg(F.count("*").alias("n")))
query("A3_counts_and_means", "SELECT kind, status, count(*) n, round(avg(quality), 6) mean_quality FROM files WHERE quality IS NOT NULL AND NOT isnan(quality) GROUP BY 1, 2")(
    lambda t: t.files.where("quality is not null and not isnan(quality)").groupBy("kind", "status").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"))
)
query("A4_people", "SELECT p.id person_id, p.name, count(f.id) n_faces, count(DISTINCT f.file_id) n_files, min(f.id) sample_face_id FROM persons p LEFT JOIN faces f ON f.person_id = p.id GROUP BY 1, 2")(lambda t: reports.people(t.faces, t.persons))
query("A5_unnamed_clusters", "SELECT cluster_id, count(*) n_faces, count(DISTINCT file_id) n_files, min(id) sample_face_id, min_by(file_id, id) sample_file_id FROM faces WHERE person_id IS NULL AND cluster_id IS NOT NULL GROUP BY 1")(
    lambda t: reports.unnamed_clusters(t.faces)
)
query("A6_loners", "SELECT count(*) n_faces, count(DISTINCT file_id) n_files FROM faces WHERE person_id IS NULL AND cluster_id IS NULL")(lambda t: reports.loners(t.faces))
query("A7_folder_rollup", f"SELECT {TOP} folder, count(*) files, count(*) FILTER (contains(path, '/') AND id IN (SELECT file_id FROM faces)) files_with_faces FROM files WHERE {LIVE} AND {TOP} IS NOT NULL GROUP BY 1")(
    lambda t: reports.folder_rollup(t.files, t.faces)
)
query("A8_A9_exact_groups", f"""
WITH k AS (SELECT *, {KEY} key FROM files WHERE {LIVE} AND {KEY} IS NOT NULL), g AS (SELECT *, count(*) OVER (PARTITION BY key) n FROM k)
SELECT min(id) OVER (PARTITION BY key) group_id, id file_id, first(id) OVER (PARTITION BY key ORDER BY {KEEP}) keep_id FROM g WHERE n > 1""")(lambda t: duplicates.exact_groups(t.files).select("group_id", "file_id", "keep_id"))
query("A10_W1_representatives", f"""
SELECT id, CASE WHEN {MD5} IS NULL OR size IS NULL OR size <= 0 THEN id
  ELSE first(id) OVER (PARTITION BY {MD5}, size ORDER BY regexp_matches(coalesce(name, ''), '{names.COPY_MARK}'), coalesce(nullif(created_time, ''), '9999'), id) END rep_id FROM files""")(lambda t: duplicates.representatives(t.files))
query("A12_register_summary", f"SELECT reason, count(*) n, coalesce(sum(size), 0)::BIGINT bytes, count(*) FILTER (coalesce(md5, '') <> '') with_md5 FROM ({_REGISTER}) GROUP BY 1")(
    lambda t: reports.register_summary(reports.trashed_register(t.files, actions_of(t), reasons_of(t)))
)
_CAT = ORACLES["F9_category"].split("SELECT id, ")[1].split(" END category")[0] + " END"
query("A13_W6_folder_size", f"""
WITH l AS (SELECT id, coalesce(size, 0) size, {MD5} m, {_CAT} c FROM listing), u AS (SELECT *, m IS NULL OR id = min(id) OVER (PARTITION BY m) first FROM l)
SELECT count(*) files, coalesce(sum(size), 0)::BIGINT bytes, count(*) FILTER (first) uniq_files, coalesce(sum(size) FILTER (first), 0)::BIGINT uniq_bytes, coalesce(sum(size) FILTER (NOT first), 0)::BIGINT dup_bytes,
  count(*) FILTER (c = 'photos') photos, count(*) FILTER (c = 'videos') videos, count(*) FILTER (c = 'audio') audio, count(*) FILTER (c = 'other') other FROM u""")(lambda t: reports.folder_size(t.listing))
query("A14_centroids", f"""
WITH v AS (SELECT person_id, {_UNIT} u FROM faces WHERE person_id IS NOT NULL AND {FACES_OK}), e AS (SELECT person_id, unnest(u) x, generate_subscripts(u, 1) i FROM v),
m AS (SELECT person_id, i, avg(x) x FROM e GROUP BY 1, 2) SELECT person_id, i::INTEGER - 1 i, round(x / sqrt(sum(x * x) OVER (PARTITION BY person_id)), 6) x FROM m""")(
    lambda t: vectors.centroids(t.faces, "person_id").select("person_id", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))
)
query("A15_video_vectors", """
WITH e AS (SELECT file_id, unnest(vec::DOUBLE[]) x, generate_subscripts(vec, 1) i FROM faces WHERE len(vec) = 128), m AS (SELECT file_id, i, avg(x) x FROM e GROUP BY 1, 2)
SELECT file_id, i::INTEGER - 1 i, round(x / sqrt(sum(x * x) OVER (PARTITION BY file_id)), 6) x FROM m QUALIFY sum(x * x) OVER (PARTITION BY file_id) > 0""")(
    lambda t: frames.mean_vectors(t.faces, "file_id", 128).select("file_id", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 6))
)
query("A16_best_labels", f"SELECT file_id, label, score, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, label) rank_no FROM (SELECT file_id, label, max(score) score FROM {LABELS} GROUP BY 1, 2) QUALIFY rank_no <= 3")(
    lambda t: frames.best_labels(listing.labels_of(t.files))
)
query("A17_R13_strangers", f"""
WITH f AS (SELECT id, file_id, coalesce(person_id IN (1, 2), false) OR coalesce(cluster_id IN (3), false) known, {FACES_OK} ok, vec FROM faces),
v AS (SELECT id, known, {_UNIT} u FROM (SELECT * FROM f WHERE ok)),
s AS (SELECT a.id, max(list_dot_product(a.u, b.u)) s FROM v a CROSS JOIN v b WHERE b.known GROUP BY 1)
SELECT file_id, count(*) n_faces, round(max(greatest(coalesce(s, 0), 0)), 2) closest FROM f LEFT JOIN s USING (id)
WHERE file_id IN (SELECT id FROM files WHERE {LIVE}) GROUP BY 1 HAVING NOT bool_or(known OR coalesce(s, 0) >= 0.45)""")(lambda t: vectors.strangers(t.files, t.faces, [1, 2], [3]))
query("A18_person_files", f"SELECT DISTINCT files.id, files.name, kind FROM faces f JOIN files ON files.id = f.file_id WHERE f.person_id = 17 AND {LIVE}")(
    lambda t: listing.with_persons(duplicates.live(t.files), t.faces, [17]).select("id", "name", "kind")
)
query("F3_A21_live_groups", f"SELECT group_id, count(DISTINCT file_id) n FROM dup_members JOIN files ON files.id = file_id WHERE {LIVE} GROUP BY 1 HAVING count(DISTINCT file_id) >= 2")(
    lambda t: listing.live_members(t.dup_members, t.files).groupBy("group_id").agg(F.count_distinct("file_id").alias("n"))
)
query("EXT_rollup", "SELECT kind, status, count(*) n FROM files GROUP BY ROLLUP (kind, status)")(lambda t: t.files.rollup("kind", "status").agg(F.count("*").alias("n")))
query("EXT_pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(*) n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")(
    lambda t: t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
)

# Ordered operators.
query("W3_sharpest", "SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY sharpness DESC, id) rank_no FROM video_frames WHERE sharpness IS NOT NULL AND file_id IS NOT NULL QUALIFY rank_no <= 20")(lambda t: frames.sharpest(t.video_frames))
query("W2_scene_changes")(lambda t: frames.scene_changes(t.video_frames))
query("W5_sibling_names", """
SELECT id, CASE WHEN row_number() OVER (PARTITION BY folder, name ORDER BY id) = 1 THEN name
  ELSE regexp_extract(name, '^(.+?)(\\.[^.]*)?$', 1) || ' [' || right(id::VARCHAR, 6) || ']' || regexp_extract(name, '^(.+?)(\\.[^.]*)?$', 2) END target
FROM (SELECT id, name, split_part(path, '/', 1) folder FROM files)""")(lambda t: changes.sibling_names(t.files.select("id", "name", F.element_at(F.split("path", "/"), 1).alias("folder")), "folder", "name", "id").select("id", "target"))
query("W4_numbered_names")(
    lambda t: changes.numbered_names(t.files.select("id", "name", listing.year_text(t.files).alias("year"), "path"), "year", "name", ["path", "id"]).select("id", "year", "target")
)
query("W7_cluster_numbers", "WITH c AS (SELECT person_id, min(id) first FROM faces WHERE person_id IS NOT NULL GROUP BY 1) SELECT person_id, row_number() OVER (ORDER BY first) cluster_no FROM c")(
    lambda t: vectors.numbered(t.faces.where("person_id is not null").groupBy("person_id").agg(F.min("id").alias("first")), ["first"], "cluster_no").drop("first")
)
query("K1_first_page", f"SELECT id, coalesce(taken_time, created_time) shot FROM files WHERE {LIVE} ORDER BY shot DESC NULLS LAST, id LIMIT 60 OFFSET 60")(
    lambda t: listing.page(duplicates.live(t.files), listing.newest_first(), 1, 60).select("id", F.coalesce("taken_time", "created_time").alias("shot"))
)
query("J1_K2_best_first", f"SELECT group_id, file_id, similarity FROM dup_members JOIN files ON files.id = file_id WHERE {LIVE} AND similarity IS NOT NULL ORDER BY similarity DESC, group_id, file_id LIMIT 60")(
    lambda t: listing.page(t.dup_members.join(duplicates.live(t.files).select(F.col("id").alias("file_id")), "file_id", "left_semi").where("similarity is not null"), [F.desc("similarity"), F.col("group_id"), F.col("file_id")]).select("group_id", "file_id", "similarity")
)
query("K4_latest_actions", f"SELECT id, file_id FROM {ACTIONS} ORDER BY id DESC LIMIT 200")(lambda t: listing.tall(actions_of(t), 200, [F.desc("id")]).select("id", "file_id"))
query("K5_cover_faces", "SELECT person_id, max(det_score) det_score FROM faces WHERE person_id IS NOT NULL GROUP BY 1")(
    lambda t: reports.latest_per_group(t.faces.where("person_id is not null"), "person_id", "det_score", ["id"]).select("person_id", "det_score")
)
query("K7_ordered", "SELECT id, path, name FROM files")(lambda t: t.files.orderBy("path", "name", "id").select("id", "path", "name"))
query("K8_listing_cap", "SELECT id FROM listing ORDER BY source, path, id LIMIT 100")(lambda t: listing.tall(t.listing, 100, [F.col("source"), F.col("path"), F.col("id")]).select("id"))
query("K10_details", "SELECT id, t, sharpness FROM video_frames WHERE file_id = 1001 ORDER BY t")(lambda t: listing.lookup(t.video_frames, "file_id", 1001).orderBy("t", "id").select("id", "t", "sharpness"))

# Graphs and groups.
_REACH = "u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), reach(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a)"
query("G1_components", f"WITH RECURSIVE e AS (SELECT file_id_a a, file_id_b b FROM match_pairs WHERE is_match), {_REACH} SELECT least(min(b), a) group_id, a node FROM reach GROUP BY a")(
    lambda t: connected_components(t.match_pairs.where("is_match"), "file_id_a", "file_id_b")
)
_EXACT = f"""
xk AS (SELECT *, {KEY} key FROM files WHERE {LIVE} AND {KEY} IS NOT NULL), xg AS (SELECT *, count(*) OVER (PARTITION BY key) n FROM xk),
xr AS (SELECT id FROM (SELECT id, first(id) OVER (PARTITION BY key ORDER BY {KEEP}) keep FROM xg WHERE n > 1) WHERE id <> keep)"""
query("G2_R7_near_groups", f"""
WITH RECURSIVE {_EXACT}, p AS (SELECT *, {PHASH.format('phash')} h FROM files WHERE {LIVE} AND kind = 'photo' AND id NOT IN (SELECT id FROM xr)),
e AS (SELECT a.id a, b.id b FROM p a JOIN p b ON a.id < b.id AND bit_count(xor(a.h, b.h)::BIT) <= 7), {_REACH}, g AS (SELECT least(min(b), a) group_id, a id FROM reach GROUP BY a)
SELECT group_id, id file_id, first(id) OVER (PARTITION BY group_id ORDER BY {KEEP}) keep_id FROM g JOIN files USING (id)""")(
    lambda t: duplicates.near_groups(t.files, materialise(duplicates.exact_groups(t.files), "exact")).select("group_id", "file_id", "keep_id")
)
query("G3_video_groups", f"""
WITH RECURSIVE {_FILMS}, {_CLIPS}, {_EXACT.replace("FROM files", "FROM films")}, {_OVERLAP.replace("<videos>", f"SELECT id FROM films WHERE {LIVE} AND kind = 'video' AND id NOT IN (SELECT id FROM xr)").replace("video_frames", "clips")},
e AS (SELECT s a, l b FROM o WHERE overlap >= 0.7), {_REACH}, g AS (SELECT least(min(b), a) group_id, a id FROM reach GROUP BY a)
SELECT group_id, id file_id, first(id) OVER (PARTITION BY group_id ORDER BY {KEEP}) keep_id FROM g JOIN films USING (id)""")(
    lambda t: duplicates.video_groups(_films(t), _clips(t), materialise(duplicates.exact_groups(_films(t)), "exact")).select("group_id", "file_id", "keep_id")
)
query("G4_dbscan", f"""
WITH RECURSIVE v AS (SELECT id, {_UNIT} u FROM faces WHERE {FACES_OK}), e AS (SELECT a.id a, b.id b FROM v a JOIN v b ON a.id < b.id AND list_dot_product(a.u, b.u) >= 0.65), {_REACH}
SELECT least(min(b), a) cluster, a id FROM reach GROUP BY a""")(
    lambda t: connected_components(alike_links(t.faces, 0.65, 128)).select(F.col("group_id").alias("cluster"), F.col("node").alias("id"))
)
query("R6_explanations")(lambda t: duplicates.explain_groups(duplicates.all_groups(t.files, t.video_frames), t.files))
query("R16_inherit", f"""
WITH r AS (SELECT *, CASE WHEN {MD5} IS NULL OR size IS NULL OR size <= 0 THEN id
  ELSE first(id) OVER (PARTITION BY {MD5}, size ORDER BY regexp_matches(coalesce(name, ''), '{names.COPY_MARK}'), coalesce(nullif(created_time, ''), '9999'), id) END rep FROM files)
SELECT c.id, CASE WHEN p.id IS NULL THEN c.status ELSE 'analyzed' END status, coalesce(c.taken_time, p.taken_time) taken_time, CASE WHEN p.id IS NULL THEN c.width ELSE p.width END width
FROM r c LEFT JOIN files p ON p.id = c.rep AND c.id <> c.rep AND p.status = 'analyzed'""")(lambda t: duplicates.inherit_analysis(t.files, duplicates.representatives(t.files)).select("id", "status", "taken_time", "width"))
query("R5_labels", f"SELECT file_id, label, score FROM {LABELS}")(lambda t: listing.labels_of(t.files).select("file_id", "label", "score"))
query("R17_search", f"SELECT id, 1.0::DOUBLE score FROM files WHERE {LIVE} AND substr(coalesce(taken_time, created_time), 1, 4) = '2018' ORDER BY id LIMIT 60")(
    lambda t: search("2018", t.files, t.faces, t.persons, listing.labels_of(t.files)).select("id", "score")
)
query("R18_summaries", """
SELECT f.id file_id, coalesce(round_even(CASE WHEN isnan(f.duration) THEN 0 ELSE f.duration END, 0), 0)::BIGINT || 's video; ' || coalesce(n, 0) || ' frames sampled across full duration; ' || coalesce(s, 0) || ' distinct scenes'
  || CASE WHEN k > 0 THEN '; ' || k || ' face detections' ELSE '' END || '.' summary
FROM files f LEFT JOIN (SELECT file_id, count(*) n, sum(is_representative) s FROM video_frames GROUP BY 1) v ON v.file_id = f.id LEFT JOIN (SELECT file_id, count(*) k FROM faces GROUP BY 1) c ON c.file_id = f.id WHERE kind = 'video'""")(
    lambda t: frames.video_summaries(t.files, t.video_frames, t.faces)
)
@query("S5_tree", """
WITH c AS (SELECT 'c' || c_custkey id, 'n' || c_nationkey parent, c_name AS name FROM customer)
SELECT 'r' || r_regionkey id, 0::BIGINT AS depth, r_name path FROM region
UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT c.id, 2, r_name || '/' || n_name || '/' || c.name FROM c JOIN nation ON parent = 'n' || n_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _tree(t):
    node = lambda d, p, k, pp, pk, n: d.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), (F.concat(F.lit(pp), F.col(pk).cast("string")) if pp else F.lit(None).cast("string")).alias("parent"), F.col(n).alias("name"))
    regions = node(t.region, "r", "r_regionkey", "", "", "r_name")
    rest = node(t.nation, "n", "n_nationkey", "r", "n_regionkey", "n_name").unionByName(node(t.customer, "c", "c_custkey", "n", "c_nationkey", "c_name"))
    return trees.walk(regions.unionByName(rest), regions)


# Scalars.
query("X1_digests", "SELECT doc_id, md5(text) m, sha256(text) s FROM documents")(lambda t: t.documents.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("m"), F.sha2(F.encode("text", "UTF-8"), 256).alias("s")))
query("X3_X4_bits", f"WITH p AS (SELECT id, {PHASH.format('phash')} h FROM files) SELECT id, bit_count(xor(h, 255::UBIGINT)::BIT)::INTEGER d, ((h >> 8) & 255::UBIGINT)::BIGINT byte1 FROM p WHERE h IS NOT NULL")(
    lambda t: t.files.select("id", phash64(F.col("phash")).alias("h")).where("h is not null").select("id", hamming(F.col("h"), F.lit(255).cast("bigint")).alias("d"), byte_chunk(F.col("h"), 1).alias("byte1"))
)
query("X5_X6_names", f"SELECT id, regexp_matches(coalesce(name, ''), '{names.COPY_NAME}') copied, regexp_matches(coalesce(name, ''), '{names.SCREEN_NAME}') screen, regexp_matches(coalesce(name, ''), '{names.MESSENGER_NAME}') messenger FROM files")(
    lambda t: t.files.select("id", names.looks_copied(F.col("name")).alias("copied"), F.coalesce("name", F.lit("")).rlike(names.SCREEN_NAME).alias("screen"), F.coalesce("name", F.lit("")).rlike(names.MESSENGER_NAME).alias("messenger"))
)
query("X7_year_in_name")(lambda t: t.files.select("id", names.year_in_name(F.col("name"), 2027).alias("year")))
query("X11_safe_names", "SELECT id, coalesce(nullif(trim(replace(path, '/', '⁄')), ''), '_') safe FROM files")(lambda t: t.files.select("id", names.safe_name(F.col("path")).alias("safe")))
query("X12_exif_time", "SELECT id, regexp_replace(regexp_replace(taken_time, '^(\\d{4}):(\\d{2}):', '\\1-\\2-'), '^(\\S+) ', '\\1T') shot FROM files WHERE taken_time IS NOT NULL")(
    lambda t: t.files.where("taken_time is not null").select("id", media.exif_time(F.col("taken_time")).alias("shot"))
)
query("X13_A19_years")(
    lambda t: reports.year_counts(t.files.select(names.resolved_year(F.lit(None).cast("int"), F.expr("try_cast(regexp_extract(taken_time, '^((?:19|20)[0-9]{2})', 1) as int)"), F.col("kind") == "video", names.year_in_name(F.col("name"), 2027), F.year("indexed_at")).alias("resolved")))
)
query("X14_date_rank", "SELECT id, list_sum(list_transform(string_split(substr(coalesce(nullif(coalesce(taken_time, created_time), ''), '9999'), 1, 10), ''), lambda c: unicode(c)))::INTEGER r FROM files")(
    lambda t: t.files.select("id", media.date_text_rank(F.coalesce("taken_time", "created_time")).alias("r"))
)
query("X16_degrees", "SELECT id, CASE WHEN gps_lat < 0 THEN -1 ELSE 1 END * (floor(abs(gps_lat)) + 30 / 60.0::DOUBLE) d FROM files WHERE gps_lat IS NOT NULL AND NOT isnan(gps_lat)")(
    lambda t: t.files.where("gps_lat is not null and not isnan(gps_lat)").select("id", media.decimal_degrees(F.floor(F.abs("gps_lat")).cast("double"), F.lit(30.0), F.lit(0.0), F.when(F.col("gps_lat") < 0, "S").otherwise("N")).alias("d"))
)
query("X18_quality", "SELECT id, round(0.5 * least(1.0, sharpness / 500) + 0.25 * (1 - least(1.0, abs(0.3 - 0.45) / 0.45)) + 0.25 * least(1.0, 2.0 / 8), 3)::DOUBLE q FROM video_frames WHERE sharpness IS NOT NULL")(
    lambda t: t.video_frames.where("sharpness is not null").select("id", media.quality_score(F.col("sharpness"), F.lit(0.3).cast("double"), F.lit(2.0).cast("double")).alias("q"))
)
query("X19_K6_softmax", """
WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp(x * 20)) e FROM embeddings), p AS (SELECT vec_id, unnest(e) / list_sum(e) p, generate_subscripts(e, 1) i FROM s)
SELECT vec_id, 'l' || (i - 1) AS label, round(p, 6) p FROM p WHERE p > 0.15 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) <= 3""")(
    lambda t: t.embeddings.select("vec_id", F.explode(top_labels(F.array(*[F.lit(f"l{i}") for i in range(64)]), softmax(F.transform("embedding", lambda x: x.cast("double"))))).alias("l")).select("vec_id", F.col("l.label").alias("label"), F.round("l.p", 6).alias("p"))
)
query("X20_cosine", f"SELECT a.file_id, round(list_cosine_similarity(a.vec::DOUBLE[], {_ONES}::DOUBLE[]), 6) s FROM file_embeddings a WHERE {FACES_OK.replace('128', '64')}")(
    lambda t: t.file_embeddings.where(comparable(F.col("vec"), 64)).select("file_id", F.round(cosine(F.col("vec"), F.array(*[F.lit(x) for x in _ONES])), 6).alias("s"))
)
query("X22_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT k FROM events")(lambda t: t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))
query("X24_sampling", """
WITH v AS (SELECT id, duration, greatest(1.0, duration / 300) step FROM files WHERE kind = 'video' AND duration IS NOT NULL AND NOT isnan(duration) AND duration >= 0)
SELECT id file_id, i::INTEGER n, round(least(i * step + step / 2, greatest(0, duration - 1)), 6) t FROM (SELECT *, unnest(generate_series(0, greatest(1, floor(duration / step))::BIGINT - 1)) i FROM v)""")(
    lambda t: frames.sampled_times(t.files).withColumn("t", F.round("t", 6))
)
query("X25_padded_box", "SELECT id, round(greatest(0, bbox[1] - 0.35 * (bbox[3] - bbox[1])), 6) x1, round(least(4000, bbox[3] + 0.35 * (bbox[3] - bbox[1])), 6) x2 FROM faces WHERE bbox IS NOT NULL")(
    lambda t: t.faces.where("bbox is not null").select("id", media.padded_box(F.col("bbox"), F.lit(4000), F.lit(4000)).alias("b")).select("id", F.round(F.get("b", F.lit(0)), 6).alias("x1"), F.round(F.get("b", F.lit(2)), 6).alias("x2"))
)
query("X26_human_bytes", "SELECT id, CASE WHEN size >= 1e9 THEN printf('%.2f GB', size / 1e9) ELSE printf('%.1f MB', size / 1e6) END h FROM files WHERE size IS NOT NULL")(
    lambda t: t.files.where("size is not null").select("id", names.human_bytes(F.col("size")).alias("h"))
)

# Sources, sinks and changes over views of the tables.
_MEDIA = "(mime LIKE '%image/%' OR mime LIKE '%video/%')"


@query("S4_drive_listing", f"SELECT id::VARCHAR source_id, name, mime, coalesce(size, 0) size, md5 FROM listing WHERE {_MEDIA}")
def _drive(t):
    item = F.struct(F.col("id").cast("string").alias("id"), "name", F.col("mime").alias("mimeType"), F.col("size").cast("string").alias("size"), F.col("md5").alias("md5Checksum"))
    pages = t.listing.select(F.to_json(F.struct(F.array(item).alias("files"))).alias("value"))
    return source_files.drive_listing(pages).select("source_id", "name", "mime", "size", "md5")


@query("S8_ledger", "SELECT md5, path, size FROM listing WHERE md5 IS NOT NULL AND md5 <> '' QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY id DESC) = 1")
def _ledger(t):
    at = scratch_path(t.spark, "ledger")
    sinks.append_lines(t.listing.orderBy("id").select("md5", "path", "size"), at)
    return source_files.ledger(t.spark, at)


@query("S9_skipped", "SELECT path drive_path, md5, name kept_copy, size FROM listing")
def _skipped(t):
    at = scratch_path(t.spark, "skipped")
    sinks.append_lines(t.listing.select(F.col("path").alias("drive_path"), "md5", F.col("name").alias("kept_copy"), "size"), at)
    return source_files.skipped_report(t.spark, at)


query("S10_sidecars", "SELECT path, 2000 + id % 25 AS year FROM (SELECT path, min(id) id FROM files WHERE path IS NOT NULL AND path <> '' AND NOT ends_with(path, '/') GROUP BY 1)")(
    lambda t: (lambda m: source_files.sidecar_years(m.select("path"), m.select(F.concat("path", F.lit(".json")).alias("path"), F.format_string('{"photoTakenTime": {"timestamp": "%d"}}', F.unix_timestamp(F.make_timestamp(2000 + F.col("id") % 25, F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))).alias("value"))).withColumn("year", F.col("year").cast("bigint")))(
        t.files.where("path is not null and path <> '' and not endswith(path, '/')").groupBy("path").agg(F.min("id").alias("id"))
    )
)


@query("O1_O2_exports", "SELECT id, size, status FROM files UNION ALL SELECT id, size, status FROM files")
def _exports(t):
    at, rows = scratch_path(t.spark, "export"), t.files.select("id", "size", "status")
    sinks.write_csv(rows, f"{at}/csv")
    sinks.write_tables({"files": rows}, at)
    return t.spark.read.schema("id bigint, size bigint, status string").option("header", "true").csv(f"{at}/csv").unionByName(t.spark.read.parquet(f"{at}/files"))


@query("O3_O4_undo", "SELECT id seq, 'sorted/' || name AS \"from\", path AS \"to\" FROM files UNION ALL SELECT id, 'sorted/' || name, path FROM listing")
def _undo(t):
    at = scratch_path(t.spark, "manifest")
    for rows in (t.files, t.listing):
        sinks.append_lines(rows.select(F.col("id").alias("seq"), F.col("path").alias("from"), F.concat(F.lit("sorted/"), "name").alias("to")), at)
    return sinks.undo_plan(t.spark, at)


query("U4_set_columns", "SELECT id, CASE WHEN size > 5000000 THEN 'large' ELSE status END status, size FROM files")(lambda t: changes.set_columns(t.files.select("id", "status", "size"), "size > 5000000", status="large"))
query("X9_R17_person_search", f"""
WITH v AS (SELECT file_id id, list_cosine_similarity(vec::DOUBLE[], {_ONES}::DOUBLE[]) s FROM file_embeddings JOIN files ON files.id = file_id WHERE {LIVE} AND {FACES_OK.replace('128', '64')})
SELECT id, round(s, 3) score FROM v WHERE id IN (SELECT file_id FROM faces WHERE person_id = (SELECT min(id) FROM persons WHERE name = (SELECT name FROM persons WHERE id = 17))) ORDER BY round(s, 9) DESC, id LIMIT 60""")(
    lambda t: search(t.persons.where("id = 17").first()["name"].upper(), t.files, t.faces, t.persons, listing.labels_of(t.files), t.file_embeddings, lambda text: _ONES).select("id", "score")
)
query("K3_R17_vector_search", f"""
WITH v AS (SELECT file_id id, list_cosine_similarity(vec::DOUBLE[], {_ONES}::DOUBLE[]) s FROM file_embeddings JOIN files ON files.id = file_id WHERE {LIVE} AND {FACES_OK.replace('128', '64')})
SELECT id, round(s, 3) score FROM v WHERE s >= 0.18 ORDER BY round(s, 9) DESC, id LIMIT 60""")(
    lambda t: search("old harbour", t.files, t.faces, t.persons, listing.labels_of(t.files), t.file_embeddings, lambda text: _ONES).select("id", "score")
)

# Streams, run over whole tables.
query("T_windows", "SELECT date_trunc('hour', ts) start, event_type, count(*) n, round(sum(value), 6) total FROM events GROUP BY 1, 2")(lambda t: ingest.windowed_counts(t.events))
query("T_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM e)
SELECT user_id, min(ts) start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) n FROM s GROUP BY user_id, k""")(lambda t: ingest.session_counts(t.events))
