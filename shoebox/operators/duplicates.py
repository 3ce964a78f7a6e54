"""Exact, near and video duplicates, and the member worth keeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.config import DEFAULT, EngineConfig
from shoebox.functions.hashes import checksum, phash64
from shoebox.functions.media import date_text_rank
from shoebox.functions.names import COPY_MARK, looks_copied
from shoebox.operators.components import connected_components
from shoebox.operators.hamming import hamming_join
from shoebox.scratch import materialise

# The similarity that members of a group carry, by kind of group.
SIMILARITY = {"exact": 1.0, "near": 0.891, "video": 0.7}


def live(files: DataFrame) -> DataFrame:
    """Rows whose status is not trashed; a null status is left out."""
    return files.where("status <> 'trashed'")


def checksum_key(md5: Column, sha256: Column) -> Column:
    """md5 where there is one, else sha256, as text; checksums of nothing do not count."""
    m, s = checksum(md5, "md5"), checksum(sha256, "sha256")
    return F.when(m.isNotNull(), F.concat(F.lit("md5:"), F.lower(F.hex(m)))).otherwise(F.lower(F.hex(s)))


def keep_order(compat: bool = False) -> list[Column]:
    """Best first: resolution, quality, size, original-looking name, earliest date; the smaller id settles ties.

    ``compat`` orders dates by the character codes of their text instead.
    """
    pixels = F.coalesce("width", F.lit(0)).cast("bigint") * F.coalesce("height", F.lit(0))
    when = F.coalesce("taken_time", "created_time")
    date = date_text_rank(when).asc() if compat else F.coalesce(F.substring(when, 1, 19), F.lit("9999")).asc()
    return [pixels.desc(), F.round(F.coalesce(F.nanvl("quality", F.lit(0.0)), F.lit(0.0)), 2).desc(), F.coalesce("size", F.lit(0)).desc(), looks_copied(F.col("name")).asc(), date, F.col("id").asc()]


def rank_members(members: DataFrame, group: str, compat: bool = False) -> DataFrame:
    """Add is_keeper: true for the best member of each group.

    The best of a group is found in two steps, salted, so that a group of any size is ranked in bounded pieces.
    """
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = Window.partitionBy(group, "_salt").orderBy(*keep_order(compat))
    best = salted.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*keep_order(compat)))).where("_r = 1")
    keepers = best.select(F.col(group), F.col("id").alias("keep_id"))
    return members.join(keepers, group).withColumn("is_keeper", F.col("id") == F.col("keep_id"))


def _described(members: DataFrame, kind: str) -> DataFrame:
    return members.select("group_id", F.lit(kind).alias("kind"), F.col("id").alias("file_id"), "keep_id", F.when(F.col("is_keeper"), 1.0).otherwise(SIMILARITY[kind]).alias("similarity"))


def exact_groups(files: DataFrame, compat: bool = False) -> DataFrame:
    """(group_id, kind, file_id, keep_id, similarity) of live files with equal checksums; group_id is the smallest id."""
    keyed = live(files).withColumn("_key", checksum_key(F.col("md5"), F.col("sha256"))).where("_key is not null")
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_n"), F.min("id").alias("group_id")).where("_n > 1").drop("_n")
    return _described(rank_members(keyed.join(sizes, "_key"), "group_id", compat), "exact")


def redundant(exact: DataFrame) -> DataFrame:
    """Ids of the exact members that are not kept."""
    return exact.where("file_id <> keep_id").select(F.col("file_id").alias("id"))


def near_links(hashed: DataFrame, max_distance: int = 7) -> DataFrame:
    """(a, b): links among rows (id, h) at ``max_distance`` or less; equal hashes form a star."""
    reps = materialise(hashed.groupBy("h").agg(F.min("id").alias("rep")), "reps")
    met = hamming_join(reps.select("h"), reps.select("h"), max_distance, same=True)
    for s in "ab":
        met = met.join(reps.select(F.col("h").alias(f"h_{s}"), F.col("rep").alias(s)), f"h_{s}")
    stars = hashed.join(reps, "h").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return met.select("a", "b").unionByName(stars)


def near_groups(files: DataFrame, exact: DataFrame, max_distance: int = 7, compat: bool = False) -> DataFrame:
    """Groups of live photos with close perceptual hashes; exact copies that are not kept take no part."""
    photos = live(files).where("kind = 'photo'").join(redundant(exact), "id", "left_anti")
    hashed = materialise(photos.select("id", phash64(F.col("phash")).alias("h")).where("h is not null"), "hashed")
    members = connected_components(near_links(hashed, max_distance)).select("group_id", F.col("node").alias("id"))
    return _described(rank_members(photos.join(members, "id"), "group_id", compat), "near")


def video_overlaps(frames: DataFrame, videos: DataFrame, max_distance: int = 8, least: float = 0.7) -> DataFrame:
    """(a, b, overlap): videos of which at least a share ``least`` of the shorter one's frames has a close frame in the other.

    The shorter is the one of fewer frames, the smaller id where both have as many. Close frames are found among
    distinct hashes by the pigeonhole join. Two videos can only share that much if they share one of the shorter one's
    rarest frames, all but the share that may be missing; only those propose pairs, so a frame that all videos have proposes none
    unless a video has little else. Proposed pairs are then counted over all frames.
    """
    f = frames.select(F.col("file_id").alias("id"), phash64(F.col("phash")).alias("h")).where("h is not null and id is not null").join(videos.select("id"), "id", "left_semi")
    uses = materialise(f.groupBy("id", "h").agg(F.count("*").alias("n")), "uses")
    lengths = uses.groupBy("id").agg(F.sum("n").alias("len"))
    hashes = materialise(uses.select("h").distinct(), "hashes")
    met = hamming_join(hashes, hashes, max_distance, same=True).select("h_a", "h_b")
    met = met.unionByName(met.select(F.col("h_b").alias("h_a"), F.col("h_a").alias("h_b"))).unionByName(hashes.select(F.col("h").alias("h_a"), F.col("h").alias("h_b")))
    met = materialise(met, "met")
    # Uses of the frames close to each frame: an upper bound of the pairs it proposes.
    common = met.join(uses.groupBy(F.col("h").alias("h_b")).agg(F.count("*").alias("uses")), "h_b").groupBy(F.col("h_a").alias("h")).agg(F.sum("uses").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "h")
    ranked = uses.join(lengths, "id").join(common, "h").withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ranked = materialise(ranked, "ranked")
    side = lambda d, s: d.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "h", "n", "len")])
    shorter = (F.col("id_a") != F.col("id_b")) & ((F.col("len_a") < F.col("len_b")) | (F.col("len_a") == F.col("len_b")) & (F.col("id_a") < F.col("id_b")))
    rare = side(ranked.where(F.col("before") <= F.col("len") - F.ceil(F.col("len") * least)), "a")
    proposed = rare.join(met, "h_a").join(side(ranked, "b"), "h_b").where(shorter).select("id_a", "id_b").distinct()
    # Each frame of the shorter one counts once, however many close frames the longer one has.
    pairs = proposed.join(side(ranked, "a"), "id_a").join(met, "h_a").join(side(ranked, "b").select("id_b", "h_b"), ["id_b", "h_b"])
    shared = pairs.select("id_a", "id_b", "h_a", "n_a", "len_a").distinct().groupBy("id_a", "id_b", "len_a").agg(F.sum("n_a").alias("same"))
    out = shared.withColumn("overlap", F.col("same") / F.col("len_a")).where(F.col("overlap") >= least)
    return out.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "overlap")


def video_groups(files: DataFrame, frames: DataFrame, exact: DataFrame, max_distance: int = 8, least: float = 0.7, compat: bool = False) -> DataFrame:
    """Groups of live videos whose sampled frames overlap; exact copies that are not kept take no part."""
    videos = live(files).where("kind = 'video'").join(redundant(exact), "id", "left_anti")
    members = connected_components(video_overlaps(frames, videos, max_distance, least)).select("group_id", F.col("node").alias("id"))
    return _described(rank_members(videos.join(members, "id"), "group_id", compat), "video")


def all_groups(files: DataFrame, frames: DataFrame, compat: bool = False, kind: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Exact, near and video groups together, or those of one kind; the ids of a kind's groups are file ids, so (kind, group_id) is the key.

    Only what the kind needs is computed.
    """
    exact = materialise(exact_groups(files, compat), "exact")
    makers = {
        "exact": lambda: exact,
        "near": lambda: near_groups(files, exact, config.phash_distance, compat),
        "video": lambda: video_groups(files, frames, exact, config.frame_distance, config.video_overlap, compat),
    }
    if kind is not None and kind not in makers:
        raise ValueError(f"no such kind of group: {kind}")
    found = [make() for name, make in makers.items() if kind in (None, name)]
    return reduce(DataFrame.unionByName, found)


def explain_groups(groups: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, group_id, keep_id, n_members, explanation): why each group's keeper is worth keeping."""
    sizes = groups.groupBy("kind", "group_id", "keep_id").agg(F.count("*").alias("n_members"))
    kept = sizes.join(files.select(F.col("id").alias("keep_id"), "name", "quality", "width", "height", "taken_time"), "keep_id")
    reasons = F.array_compact(F.array(
        F.when(F.col("quality").isNotNull() & ~F.isnan("quality"), F.format_string("highest quality score (%.2f)", "quality")),
        F.when((F.col("width") > 0) & (F.col("height") > 0), F.format_string("largest resolution (%dx%d)", "width", "height")),
        F.when(F.col("taken_time") != "", F.lit("has original capture timestamp")),
    ))
    why = F.when(F.size(reasons) > 0, F.concat_ws(", ", reasons)).otherwise("largest file")
    what = F.when(F.col("kind") == "video", "videos").otherwise("files")
    text = F.concat(F.col("n_members").cast("string"), F.lit(" "), F.col("kind"), F.lit("-duplicate "), what, F.lit("; suggest keeping '"), F.coalesce("name", F.lit("")), F.lit("' — "), why)
    return kept.select("kind", "group_id", "keep_id", "n_members", text.alias("explanation"))


def representatives(files: DataFrame) -> DataFrame:
    """(id, rep_id): who carries the analysis of identical bytes; rows without md5 or size carry their own.

    Among rows of one (md5, size) original-looking names come first, then the earlier created_time text, then the id.
    """
    key = F.when(F.col("size") > 0, checksum(F.col("md5"), "md5"))
    f = files.withColumns({"_m": key, "_copy": F.coalesce("name", F.lit("")).rlike(COPY_MARK), "_at": F.coalesce(F.nullif("created_time", F.lit("")), F.lit("9999"))})
    first = f.where("_m is not null").groupBy("_m", "size").agg(F.min(F.struct("_copy", "_at", "id")).alias("r")).select("_m", "size", F.col("r.id").alias("rep_id"))
    return f.join(first, ["_m", "size"], "left").select("id", F.coalesce("rep_id", "id").alias("rep_id"))


def inherit_analysis(files: DataFrame, reps: DataFrame) -> DataFrame:
    """Clones take status, hashes, quality, size and length of an analysed representative; their own taken_time wins."""
    fields = ["sha256", "phash", "quality", "width", "height", "duration"]
    src = files.where("status = 'analyzed'").select(F.col("id").alias("rep_id"), F.col("taken_time").alias("_taken"), *[F.col(c).alias(f"_{c}") for c in fields])
    clones = reps.where("id <> rep_id").join(src, "rep_id")
    out = files.join(clones, "id", "left")
    got = F.col("rep_id").isNotNull()
    taken = {c: F.when(got, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    out = out.withColumns(taken | {"taken_time": F.coalesce("taken_time", "_taken"), "status": F.when(got, "analyzed").otherwise(F.col("status"))})
    return out.select(*files.columns)
