"""Consolidating pairwise matches into groups.

Union-find runs inside bounded edge partitions and keeps only a spanning forest of each; forests are
merged level by level into fewer partitions until one partition holds what is left. Edges of a node lie together,
but those of a hub, a node with more edges than an eighth of a partition, are spread by their other end, so
partitions stay near the bound whatever the degrees. Where the forest of all records exceeds the bound, a contraction
step replaces it by links among the roots of the partitions and merging goes on with these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.hashes import phash64
from shoebox.operators.components import spanning_forest
from shoebox.operators.hamming import hamming_join
from shoebox.scratch import materialise

EDGES_PER_PARTITION = 1_000_000
CHUNK = 250_000
_FOREST = "root long, node long"


def _forests(batches: Iterator[pd.DataFrame], seed: int | None) -> Iterator[pd.DataFrame]:
    """Fold a stream of edges into one forest; memory follows the records met, not the edges."""
    root = node = np.empty(0, np.int64)
    held: list[pd.DataFrame] = []

    def fold():
        nonlocal root, node, held
        a = np.concatenate([root, *[h["a"].to_numpy(np.int64) for h in held]])
        b = np.concatenate([node, *[h["b"].to_numpy(np.int64) for h in held]])
        held = []
        root, node = spanning_forest(a, b, seed)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            fold()
    if held:
        fold()
    for i in range(0, len(root), CHUNK):
        yield pd.DataFrame({"root": root[i : i + CHUNK], "node": node[i : i + CHUNK]})


def deal(edges: DataFrame, partitions: int, edges_per_partition: int) -> DataFrame:
    """Edges by their first end, those of hubs by both ends.

    At most ``8 * partitions`` nodes can be hubs, so they are broadcast.
    """
    if partitions == 1:
        return edges.select("a", "b").coalesce(1)
    hubs = edges.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > max(1, edges_per_partition // 8)).select("a", F.lit(True).alias("hub"))
    place = F.when(F.col("hub"), F.xxhash64("a", "b")).otherwise(F.xxhash64("a"))
    return edges.join(F.broadcast(hubs), "a", "left").repartition(partitions, place).select("a", "b")


def _merge(edges: DataFrame, partitions: int, seed: int | None, edges_per_partition: int) -> tuple[DataFrame, int]:
    dealt = deal(edges, partitions, edges_per_partition)
    out = materialise(dealt.mapInPandas(lambda b: _forests(b, seed), _FOREST), "forest")
    return out, out.count()


def connected_components(edges: DataFrame, edges_per_partition: int = EDGES_PER_PARTITION, fan_in: int = 8) -> DataFrame:
    """(group_key, node) for every record that some link joins to another one; group_key is the smallest record.

    ``edges`` has long columns a and b. Reversed, repeated and self links, links with a null end, hubs and
    chains of any length are fine; a record whose only links are to itself is in no group; no links give no rows.
    """
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    cur = materialise(links, "links")
    size = cur.count()
    partitions = max(1, -(-size // edges_per_partition))
    solved: list[DataFrame] = []
    level = 0
    while True:
        last = partitions == 1
        forest, left = _merge(cur, partitions, None if last else level, edges_per_partition)
        if last:
            break
        fewer = max(1, -(-partitions // fan_in), -(-left // edges_per_partition))
        if left > 0.7 * size and fewer > 1:
            # Merging no longer shrinks it: hang each node below one of its roots, go on with links among roots.
            first = F.min(F.struct(F.xxhash64("root", F.lit(level)).alias("p"), F.col("root")))
            hung = materialise(forest.groupBy("node").agg(first.alias("m")).select("node", F.col("m.root").alias("up")), "hung")
            roots = forest.select(F.col("root").alias("node")).distinct()
            solved.append(hung.join(roots, "node", "left_anti"))
            among = forest.join(hung, "node").where("root <> up").select(F.col("up").alias("a"), F.col("root").alias("b"))
            kept = hung.join(roots, "node", "left_semi").select(F.col("up").alias("a"), F.col("node").alias("b"))
            cur = materialise(among.unionByName(kept).distinct(), "links")
            left = cur.count()
            fewer = max(1, -(-left // edges_per_partition))
        else:
            cur = forest.select(F.col("root").alias("a"), F.col("node").alias("b"))
        size, partitions, level = left, fewer, level + 1
    tops = forest.select("root").distinct()
    labels = forest.select(F.col("root").alias("group_key"), "node").unionByName(tops.select(F.col("root").alias("group_key"), F.col("root").alias("node")))
    if not solved:
        return labels
    for hung in reversed(solved):
        # A parent without a label of its own is the root of its tree.
        down = hung.join(labels.withColumnRenamed("node", "up"), "up", "left").select(F.coalesce("group_key", "up").alias("group_key"), "node")
        alone = hung.join(labels.withColumnRenamed("node", "up"), "up", "left_anti").select(F.col("up").alias("group_key"), F.col("up").alias("node")).distinct()
        labels = materialise(labels.unionByName(down).unionByName(alone), "labels")
    smallest = labels.groupBy("group_key").agg(F.min("node").alias("least"))
    return labels.join(smallest, "group_key").select(F.col("least").alias("group_key"), "node")


def star_links(members: DataFrame, key: str, node: str) -> DataFrame:
    """Links from every member of a key to the key's smallest member; nulls and single members give none."""
    m = members.select(F.col(key).alias("key"), F.col(node).alias("node")).where("key is not null and node is not null")
    low = m.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key", "a")
    return m.join(low, "key").where("a <> node").select("a", F.col("node").alias("b"))


def match_links(files: DataFrame, match_pairs: DataFrame, dup_members: DataFrame, max_distance: int = 7) -> DataFrame:
    """Links (a, b) of confirmed pairs, of common earlier groups and of perceptual hashes within ``max_distance``.

    Files of one hash are linked in a star and only distinct hashes are compared; a group is a star too.
    """
    pairs = match_pairs.where("is_match").select(F.col("file_id_a").alias("a"), F.col("file_id_b").alias("b"))
    groups = star_links(dup_members, "group_id", "file_id")
    hashed = files.select(F.col("id"), phash64(F.col("phash")).alias("h")).where("h is not null and id is not null")
    hashed = materialise(hashed, "hashed")
    reps = materialise(hashed.groupBy("h").agg(F.min("id").alias("rep")), "reps")
    near = hamming_join(reps.select("h"), reps.select("h"), max_distance, same=True)
    left, right = (reps.select(F.col("h").alias(f"h_{s}"), F.col("rep").alias(s)) for s in "ab")
    near = near.join(left, "h_a").join(right, "h_b").select("a", "b")
    return pairs.unionByName(groups).unionByName(star_links(hashed, "h", "id")).unionByName(near)


def consolidate(files: DataFrame, match_pairs: DataFrame, dup_members: DataFrame, max_distance: int = 7) -> DataFrame:
    """(group_key, file_id): one row per file linked directly or through others to another file.

    ``is_match`` true with two different ids links (a contradicting row changes nothing), a shared group_id
    links, perceptual hashes at ``max_distance`` or less link. Ids need not occur in ``files``. Null ids, hashes and
    verdicts link nothing; repeated rows change nothing; empty tables are fine; other columns are ignored.
    """
    out = connected_components(match_links(files, match_pairs, dup_members, max_distance))
    return out.select("group_key", F.col("node").alias("file_id"))
