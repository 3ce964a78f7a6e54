"""Evaluation texts leaking into training text.

A positional inverted index holds the postings (term, next term, document, position) of the corpus in segments of
documents, each sorted by term; it is written without a shuffle, once, and opened again by later calls. Every window of consecutive test words is looked
up only where its rarest term stands, by a run of six words around it; what these postings suggest is confirmed by
intersecting the offset-adjusted postings of the other words, and runs of agreeing positions are the matches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoebox.scratch import materialise, scratch_path

#: Rows of at most 48 bytes that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_POSTING = "doc bigint, pos int, term bigint, next int, ahead int"
#: Words after a term that its posting tells by one number.
AHEAD = 5
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC, in one case, invisible format characters left out."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
        # Folding the case can undo the normal form.
        text = unicodedata.normalize("NFKC", text.casefold())
    return _WORD.findall(text.lower())


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, pos, term, next, ahead) of every word, sorted by term within a batch of texts.

    A term is a 64-bit hash of the word, next 32 bits of the hash of the word after it, ahead 32 bits of a hash of the ``AHEAD``
    words after it; both are null where the text ends before.
    """
    for batch in batches:
        found = [words(t) for t in batch.column("text").to_pylist()]
        sizes = np.array([len(f) for f in found])
        flat = np.array([w for f in found for w in f], dtype=object)
        if not len(flat):
            continue
        codes, names = pd.factorize(flat)
        terms = pd.util.hash_array(names, categorize=False).view(np.int64)[codes]
        following, end = np.append(terms[1:], 0).astype(np.int32), np.zeros(len(terms), bool)
        end[np.cumsum(sizes)[sizes > 0] - 1] = True
        mixed = np.zeros(len(terms), np.uint64)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(terms)) - 1
        for k in range(1, AHEAD + 1):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.append(terms[k:], np.zeros(min(k, len(terms)), np.int64)).view(np.uint64)
        short = left < AHEAD
        mixed = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)
        ids = np.repeat(batch.column("id").to_numpy(), sizes)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(terms, kind="stable")
        columns = [pa.array(ids[order], pa.int64()), pa.array(pos[order], pa.int32()), pa.array(terms[order], pa.int64()), pa.array(following[order], pa.int32(), mask=end[order]), pa.array(mixed[order], pa.int32(), mask=short[order])]
        for at in range(0, len(flat), 100_000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in columns], ["id", "pos", "term", "next", "ahead"])


def term_positions(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, pos, term, next, ahead): every word of every text and what comes after it."""
    src = texts.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return src.mapInArrow(_post, "id long, pos int, term long, next int, ahead int")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a stored table of a counted, small size; a larger one is joined by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class PositionalIndex:
    """Postings of a corpus below ``path``; a path that holds a complete index already is opened, not built again."""

    def __init__(self, corpus: DataFrame | None, id_: str = "doc_id", text: str = "text", path: str | None = None, spark: SparkSession | None = None):
        self.spark = spark or corpus.sparkSession
        self.path = path or scratch_path(self.spark, "postings")
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            term_positions(corpus, id_, text).withColumnRenamed("id", "doc").write.mode("overwrite").option("compression", "zstd").parquet(self.path)

    def postings(self) -> DataFrame:
        """(doc, pos, term, next, ahead)"""
        return self.spark.read.schema(_POSTING).parquet(self.path)


def _item_terms(items: DataFrame, id_: str, text: str) -> DataFrame:
    return materialise(term_positions(items, id_, text).withColumnRenamed("id", "item").withColumnRenamed("pos", "at").distinct(), "items")


def _anchors(index: PositionalIndex, terms: DataFrame, n: int) -> DataFrame:
    """(item, rarest, at, term, next, ahead): the rarest term of each window of ``n`` test words, and a place from which a run of words holds it.

    The run is ``AHEAD`` + 1 words, or two where the windows are shorter; it always lies in the window.
    """
    asked = materialise(terms.select("term").distinct(), "terms")
    held = index.postings().select("term").join(_few(asked, asked.count()), "term", "left_semi")
    frequency = held.groupBy("term").agg(F.count("*").alias("df"))
    own = Window.partitionBy("item").orderBy("at")
    window = own.rowsBetween(0, n - 1)
    rated = terms.join(frequency, "term", "left").select("item", "at", "term", "next", F.coalesce("df", F.lit(0)).alias("df"))
    rare = F.min(F.struct("df", "term", "at")).over(window)
    found = rated.withColumn("rare", rare).withColumn("size", F.count("*").over(window)).withColumn("end", F.max("at").over(window))
    found = found.where((F.col("size") == n) & (F.col("rare.df") > 0))
    run = AHEAD if n > AHEAD else min(n, 2) - 1
    place = F.least(F.col("rare.at"), F.col("end") - run)
    found = found.select("item", F.col("rare.at").alias("rarest"), place.alias("at")).distinct()
    return materialise(found.join(terms, ["item", "at"]).select("item", "rarest", "at", "term", "next", "ahead"), "anchors")


def _confirmed(index: PositionalIndex, terms: DataFrame, aligned: DataFrame) -> DataFrame:
    """(doc, item, shift, at): item positions whose word stands at its place in the document."""
    due = aligned.join(_few(terms, terms.count()), "item").select("doc", "item", "shift", "at", "term", (F.col("shift") + F.col("at")).alias("pos"))
    due = materialise(due, "due")
    docs = materialise(due.select("doc").distinct(), "docs")
    have = index.postings().select("doc", "pos", "term").join(_few(docs, docs.count()), "doc", "left_semi")
    return have.join(_few(due, due.count()), ["doc", "pos", "term"]).select("doc", "item", "shift", "at").distinct()


def leaked_passages(corpus: DataFrame, items: DataFrame, n: int = 12, id_: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", index: PositionalIndex | None = None) -> DataFrame:
    """(doc_id, item_id, n_words): documents with at least ``n`` consecutive words of an item, nothing between; the longest run.

    Items of fewer than ``n`` words match nothing. Null and empty texts, null ids and empty tables give no rows; an
    item or document that occurs repeatedly under one id counts once; other columns are ignored. ``index`` is one of the corpus
    that was built before.
    """
    index = index or PositionalIndex(corpus, id_, text)
    terms = _item_terms(items, item_id, item_text)
    anchors = _anchors(index, terms, n)
    same = ["term", "ahead"] if n > AHEAD else ["term", "next"][: min(n, 2)]
    asked = anchors.select("item", "at", *same).distinct()
    found = index.postings().select("doc", "pos", *same).join(_few(asked, anchors.count()), same)
    aligned = materialise(found.select("doc", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "aligned")
    hits = _confirmed(index, terms, aligned)
    w = Window.partitionBy("doc", "item", "shift").orderBy("at")
    runs = hits.withColumn("run", F.col("at") - F.row_number().over(w)).groupBy("doc", "item", "shift", "run").agg(F.count("*").alias("n_words"))
    long = runs.where(F.col("n_words") >= n).groupBy("doc", "item").agg(F.max("n_words").alias("n_words"))
    return long.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_words")


def _count_near(batches: Iterator[pd.DataFrame], n: int, slop: int) -> Iterator[pd.DataFrame]:
    """Item words of each alignment that stand at most ``slop`` words off; ``pos`` counts from ``slop`` words before the item's first place."""
    reach = np.arange(2 * slop + 1)
    for batch in batches:
        counts = np.zeros(len(batch), np.int64)
        for k, (pos, term, at, wanted) in enumerate(zip(batch["pos"], batch["term"], batch["at"], batch["wanted"])):
            held, there = np.zeros(at[-1] + len(reach), np.int64), np.zeros(at[-1] + len(reach), bool)
            held[pos], there[pos] = term, True
            around = at[:, None] + reach
            counts[k] = ((held[around] == wanted[:, None]) & there[around]).any(1).sum()
        keep = counts >= n
        yield pd.DataFrame({"doc": batch["doc"][keep], "item": batch["item"][keep], "n_words": counts[keep]})


def close_passages(corpus: DataFrame, items: DataFrame, n: int = 12, slop: int = 3, id_: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", index: PositionalIndex | None = None) -> DataFrame:
    """(doc_id, item_id, n_words): proximity matches, at least ``n`` words of an item near one place in a document.

    Near means that each word stands at its place relative to the rarest term of some window of ``n``, or up
    to ``slop`` words off, so insertions, omissions and swaps of a few words are met. Rows as in :func:`leaked_passages`.
    """
    index = index or PositionalIndex(corpus, id_, text)
    terms = _item_terms(items, item_id, item_text)
    rarest = _anchors(index, terms, n).select("item", F.col("rarest").alias("at")).distinct().join(terms.select("item", "at", "term"), ["item", "at"])
    rarest = materialise(rarest, "rarest")
    # A posting near the anchor counts for its item place; of an item only the words within reach of each other are asked.
    found = index.postings().join(_few(rarest, rarest.count()), "term")
    aligned = materialise(found.select("doc", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "aligned")
    docs = materialise(aligned.select("doc").distinct(), "docs")
    asked = materialise(terms.select("term").distinct(), "terms")
    kept = index.postings().join(_few(asked, asked.count()), "term", "left_semi").join(_few(docs, docs.count()), "doc", "left_semi")
    held = kept.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("words"))
    wanted = terms.groupBy("item").agg(F.array_sort(F.collect_set(F.struct("at", "term"))).alias("item_words"))
    lead = F.struct((F.col("shift") - slop).alias("pos"))
    met = aligned.join(held, "doc").join(F.broadcast(wanted) if terms.count() <= BROADCAST_ROWS else wanted, "item")
    last = F.element_at("item_words", -1)["at"]
    near = met.select("doc", "item", "shift", "item_words", F.filter("words", lambda w: (w["pos"] >= lead["pos"]) & (w["pos"] <= F.col("shift") + last + slop)).alias("words"))
    near = near.where(F.size("words") >= n).select(
        "doc", "item", F.transform("words", lambda w: w["pos"] - lead["pos"]).alias("pos"), F.transform("words", lambda w: w["term"]).alias("term"),
        F.transform("item_words", lambda i: i["at"]).alias("at"), F.transform("item_words", lambda i: i["term"]).alias("wanted"),
    )
    counted = near.mapInPandas(lambda b: _count_near(b, n, slop), "doc long, item long, n_words long")
    out = counted.groupBy("doc", "item").agg(F.max("n_words").alias("n_words"))
    return out.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_words")
