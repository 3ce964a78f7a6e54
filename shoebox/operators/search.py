"""Hybrid search: persons, year and words or a query vector."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.config import DEFAULT, EngineConfig
from shoebox.operators.listing import keyword_search, with_persons, year_text
from shoebox.operators.vectors import top_k

RESULT = ["id", "name", "kind", "taken_time", "created_time"]


def parse_query(text: str, persons: list[tuple[int, str]]) -> tuple[list[int], int | None, str]:
    """Person ids, year and the remaining words of a query.

    The first year of 1900..2099 standing alone is taken out; each person's name that occurs as whole words, letter case
    ignored, is replaced by the word person.
    """
    found, year, rest = [], None, text.strip()
    m = re.search(r"\b(?:19|20)\d{2}\b", rest)
    if m:
        year = int(m.group())
        rest = (rest[: m.start()] + rest[m.end() :]).strip(" ,")
    for number, name in persons:
        whole = rf"\b{re.escape(name)}\b" if name else None
        if whole and re.search(whole, rest, re.IGNORECASE):
            found.append(number)
            rest = re.sub(whole, "person", rest, flags=re.IGNORECASE)
    return found, year, rest.strip()


def search(text: str, files: DataFrame, faces: DataFrame, persons: DataFrame, labels: DataFrame, embeddings: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, limit: int = 60, config: EngineConfig = DEFAULT) -> DataFrame:
    """(id, name, kind, taken_time, created_time, score), best first.

    With an ``embed`` function and words left, by similarity of embeddings (file_id, vec), from a cutoff on only where nothing
    narrows the search; with nothing left but persons or a year, all of these with score 1; else by words in
    names and labels with score 0.5. Trashed files never come out, and conditions apply before the limit.
    """
    alive = files.where("status <> 'trashed'")
    if not text.strip():
        return alive.select(*RESULT, F.lit(0.0).alias("score")).limit(0)
    # Only persons whose name occurs in the text come to the driver.
    named = persons.where((F.col("name") != "") & F.contains(F.lower(F.lit(text)), F.lower("name"))).orderBy("id").select("id", "name").collect()
    wanted, year, rest = parse_query(text, [(r["id"], r["name"]) for r in named])
    narrowed = with_persons(alive, faces, wanted) if wanted else alive
    if year:
        narrowed = narrowed.where(year_text(narrowed) == str(year))
    restricted = bool(wanted or year)
    if embed and embeddings is not None and rest:
        mine = embeddings.join(narrowed.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        hits = top_k(mine, embed(rest), limit, "file_id", least=None if restricted else config.semantic_cutoff)
        return narrowed.select(*RESULT).join(hits.withColumnRenamed("file_id", "id"), "id").orderBy(F.desc("score"), "id").select(*RESULT, "score")
    if restricted and not rest:
        return narrowed.orderBy("id").limit(limit).select(*RESULT, F.lit(1.0).alias("score"))
    hits = keyword_search(narrowed, labels, rest or text)
    return hits.orderBy("id").limit(limit).select(*RESULT, F.lit(0.5).alias("score"))
