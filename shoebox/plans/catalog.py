"""The catalogue's read reports and table changes behind one object."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.config import DEFAULT, EngineConfig
from shoebox.operators import changes, duplicates, frames, listing, reports, vectors
from shoebox.operators.alike import alike_links
from shoebox.operators.components import connected_components
from shoebox.operators.search import search
from shoebox.plans.tables import table


@dataclass(frozen=True)
class Catalog:
    """Tables of one catalogue. A change gives a new Catalog; no table is updated in place."""

    files: DataFrame
    faces: DataFrame
    persons: DataFrame
    video_frames: DataFrame
    dup_members: DataFrame
    file_embeddings: DataFrame
    config: EngineConfig = DEFAULT

    @classmethod
    def open(cls, spark: SparkSession, folder: str, config: EngineConfig = DEFAULT) -> Catalog:
        names = ("files", "faces", "persons", "video_frames", "dup_members", "file_embeddings")
        return cls(*(table(spark, folder, n) for n in names), config)

    @property
    def labels(self) -> DataFrame:
        return listing.labels_of(self.files)

    def status(self) -> DataFrame:
        return reports.overview(self.files)

    def browse(self, kind: str | None = None, status: str | None = None, label: str | None = None, page: int = 0, page_size: int = 60) -> DataFrame:
        return listing.page(listing.browse(self.files, self.labels, kind, status, label), listing.newest_first(), page, page_size)

    def detail(self, file_id: int) -> dict[str, DataFrame]:
        """The file, its labels, faces with names, and frames in order; an error for an unknown id."""
        return {
            "file": listing.required(listing.lookup(self.files, "id", file_id), "file"),
            "labels": listing.lookup(self.labels, "file_id", file_id).orderBy(F.desc("score"), "label"),
            "faces": listing.lookup(self.faces, "file_id", file_id).join(self.persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name")), "person_id", "left"),
            "frames": listing.lookup(self.video_frames, "file_id", file_id).orderBy("t", "id"),
        }

    def groups(self, kind: str | None = None) -> DataFrame:
        """Members of exact, near and video groups."""
        return duplicates.all_groups(self.files, self.video_frames, self.config.keeper_time == "compat", kind, self.config)

    def people(self) -> DataFrame:
        return reports.people(self.faces, self.persons)

    def clusters(self) -> DataFrame:
        return reports.unnamed_clusters(self.faces)

    def person_files(self, person_id: int) -> DataFrame:
        return listing.with_persons(duplicates.live(self.files), self.faces, [person_id])

    def folders(self) -> DataFrame:
        return reports.folder_rollup(self.files, self.faces)

    def strangers(self, folder: str, keep_persons: list[int], keep_clusters: list[int]) -> DataFrame:
        """Files below a folder in which only unknown people are seen; at least one person or cluster has to be kept."""
        if not keep_persons and not keep_clusters:
            raise ValueError("keep at least one person or cluster")
        found = vectors.strangers(self.files, self.faces, keep_persons, keep_clusters, self.config.cleanup_margin)
        return found.join(listing.folder_files(self.files, folder).select(F.col("id").alias("file_id")), "file_id", "left_semi")

    def search(self, text: str, limit: int = 60, embed=None) -> DataFrame:
        return search(text, self.files, self.faces, self.persons, self.labels, self.file_embeddings, embed, limit, self.config)

    def summaries(self) -> DataFrame:
        return frames.video_summaries(self.files, self.video_frames, self.faces)

    def indexed(self, rows: DataFrame, key: list[str], refreshed: list[str], kept: list[str]) -> Catalog:
        """With a listing merged into the files."""
        return replace(self, files=changes.upsert_index(self.files, rows, key, refreshed, kept))

    def with_inherited_analysis(self) -> Catalog:
        return replace(self, files=duplicates.inherit_analysis(self.files, duplicates.representatives(self.files)))

    def reclustered(self, dim: int = 128) -> Catalog:
        """Nameless faces matched to persons by centroid; those nameless before are clustered, matched ones among them too."""
        nameless = self.faces.where("person_id is null")
        matched = vectors.assign_to_centroids(nameless, vectors.centroids(self.faces, "person_id", dim=dim), "person_id", self.config.face_match, dim)
        found = connected_components(alike_links(nameless, 1 - self.config.face_eps, dim))
        out = self.faces.join(matched.select("id", F.col("person_id").alias("_person")), "id", "left").join(found.select(F.col("node").alias("id"), F.col("group_id").alias("_cluster")), "id", "left")
        new = {"cluster_id": F.when(F.col("person_id").isNull(), F.col("_cluster")).otherwise(F.col("cluster_id")), "person_id": F.coalesce("person_id", "_person")}
        return replace(self, faces=out.withColumns(new).select(*self.faces.columns))
