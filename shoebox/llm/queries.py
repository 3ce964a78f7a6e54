"""Queries over the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.llm.clusters import cluster_vectors, describe_clusters
from shoebox.llm.components import consolidate
from shoebox.llm.history import screen_batches
from shoebox.llm.leakage import close_passages, leaked_passages
from shoebox.llm.neighbours import nearest, similar_pairs
from shoebox.llm.packing import pack_sizes
from shoebox.llm.runs import collapse_runs
from shoebox.llm.sql import ORACLES
from shoebox.llm.truncation import cut_documents, truncation_by_source
from shoebox.plans.tables import table

__all__ = ["ORACLES", "QUERIES"]


def _nameless(spark, d):
    return table(spark, d, "faces").where("person_id is null")


def p1_found(spark, d):
    return cluster_vectors(_nameless(spark, d)).select("cluster_key", F.col("id").alias("face_id"))


def p1_clusters(spark, d):
    return describe_clusters(cluster_vectors(_nameless(spark, d), described=True)).withColumnRenamed("id", "face_id")


def p3_found(spark, d):
    return consolidate(table(spark, d, "files"), table(spark, d, "match_pairs"), table(spark, d, "dup_members"))


def p4_found(spark, d):
    return collapse_runs(table(spark, d, "video_frames")).select("file_id", "first_frame_id", "last_frame_id", "n_frames")


def p4_runs(spark, d):
    return collapse_runs(table(spark, d, "video_frames"))


def p6_found(spark, d):
    return screen_batches(table(spark, d, "files"), table(spark, d, "listing"))


def p7_found(spark, d):
    pairs = similar_pairs(table(spark, d, "file_embeddings"), "file_id", "vec", 64)
    return pairs.select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))


def p7_faces(spark, d):
    found = nearest(table(spark, d, "faces"), "id", "vec", 128, queries="id % 20 = 0")
    return found.select(F.col("id").alias("face_id"), F.col("other").alias("neighbour_id"), "rank_no")


def p8_packs(spark, d):
    """Packs of every size of pack_sizes."""
    sizes = {r["pack_id"]: r["capacity_tokens"] for r in table(spark, d, "pack_sizes").where("capacity_tokens > 0").collect()}
    return pack_sizes(table(spark, d, "documents"), sizes)


def p9_found(spark, d):
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_close(spark, d):
    """Proximity matches: at least 12 words of an item, each up to 3 words off its place."""
    return close_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark, d):
    return cut_documents(table(spark, d, "documents"))


def p10_sources(spark, d):
    return truncation_by_source(table(spark, d, "documents"))


QUERIES = {"p8_packs": p8_packs, "p9_found": p9_found, "p9_close": p9_close, "p10_found": p10_found, "p10_sources": p10_sources, "p1_found": p1_found, "p1_clusters": p1_clusters, "p7_found": p7_found, "p7_faces": p7_faces, "p3_found": p3_found, "p4_found": p4_found, "p4_runs": p4_runs, "p6_found": p6_found}
