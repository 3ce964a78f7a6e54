"""Walks over folder trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.names import FOLDER_ID, safe_name
from shoebox.scratch import materialise


def walk(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth, path): everything below ``roots`` (id), level by level to any depth; ``nodes`` has id, parent, name.

    One equi-join a level; paths are made of safe names. A folder below itself is an error.
    """
    named = nodes.select("id", "parent", safe_name(F.col("name")).alias("name"))
    level = named.join(roots.select("id"), "id", "left_semi").select("id", F.lit(0).cast("bigint").alias("depth"), F.col("name").alias("path"), F.array("id").alias("trail"))
    level = materialise(level, "level")
    out = level
    while True:
        up = level.select(F.col("id").alias("parent"), "depth", "path", "trail")
        below = named.join(up, "parent").select("id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), "name").alias("path"), "trail")
        level = materialise(below.withColumns({"circle": F.array_contains("trail", F.col("id")), "trail": F.concat("trail", F.array("id"))}), "level")
        if level.isEmpty():
            return out.drop("trail")
        if not level.where("circle").isEmpty():
            raise ValueError("a folder is below itself")
        level = level.drop("circle")
        out = out.unionByName(level)


def resolve_folder(nodes: DataFrame, ref: str):
    """Id of the folder that a reference names: an id as it is, else the only folder of that name; else an error."""
    import re

    if re.match(FOLDER_ID, ref):
        hit = nodes.where(F.col("id") == ref).limit(1).collect()
        if hit:
            return hit[0]["id"]
    hits = nodes.where(F.col("name") == ref).select("id").limit(2).collect()
    if not hits:
        raise KeyError(f"no folder named {ref!r}")
    if len(hits) > 1:
        raise KeyError(f"several folders are named {ref!r}")
    return hits[0]["id"]
