"""Filling fixed-capacity containers with texts measured in tokens of a public tokenizer.

Sum-of-squares packing: each text goes where the sum, over residual gaps, of the squared number of open packs
with that gap becomes smallest. Texts are dealt by a hash of their id into shards of bounded size that are packed apart.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.scratch import materialise

SHARD_TEXTS = 100_000
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, id_: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) over whole texts; a null text has no tokens."""
    vocabulary = path or vocabulary_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"]]})

    src = texts.select(F.col(id_).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return src.mapInPandas(count, "doc_id long, n_tokens long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A pack number for each size (1..capacity), in the given order.

    Moving a pack from gap g to g - s changes the sum of squares by 2 (N[g - s] - N[g] + 1), opening one by
    2 N[capacity - s] + 1, and filling one to the brim by 1 - 2 N[g]; full packs do not count. Ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_packs: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    packs = 0
    big = np.iinfo(np.int64).max // 4
    for k, s in enumerate(sizes.tolist()):
        if s == 0:
            gap = int(np.argmax(count > 0)) if packs and count.any() else 0
            out[k] = open_packs[gap][-1] if gap else max(packs - 1, 0)
            packs = max(packs, 1)
            continue
        have = count[s:]
        change = 2 * (count[: capacity + 1 - s] - have + 1)
        change[0] = 1 - 2 * have[0]
        change = np.where(have > 0, change, big)
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(change.argmin())
        if change[best] <= fresh:
            gap = best + s
            pack = open_packs[gap].pop()
            count[gap] -= 1
        else:
            gap, pack = capacity, packs
            packs += 1
        left = gap - s
        if left:
            open_packs[left].append(pack)
            count[left] += 1
        out[k] = pack
    return out


_PIECE = "pack_no long, doc_id long, piece_no long, first_token long, n_tokens long"


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of the counted texts of one shard, packs numbered from the shard on."""
    rows = rows.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
    doc, size = rows["doc_id"].to_numpy(np.int64), rows["n_tokens"].to_numpy(np.int64)
    whole = np.where(size > capacity, (size - 1) // capacity, 0)
    rest = size - whole * capacity
    last = sum_of_squares(rest, capacity) + int(whole.sum())
    full = np.repeat(np.arange(len(doc)), whole)
    piece = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = pd.DataFrame({
        "pack": np.concatenate([np.arange(len(full)), last]), "doc_id": np.concatenate([doc[full], doc]), "piece_no": np.concatenate([piece, whole]),
        "first_token": np.concatenate([piece * capacity, whole * capacity]), "n_tokens": np.concatenate([np.full(len(full), capacity), rest]),
    })
    out["pack_no"] = out.pop("pack") + (int(rows["shard"].iloc[0]) << 32)
    return out[["pack_no", "doc_id", "piece_no", "first_token", "n_tokens"]]


def _dealt(texts: DataFrame, id_: str, text: str, path: str | None, shard_texts: int) -> tuple[DataFrame, int]:
    counted = materialise(token_counts(texts, id_, text, path), "tokens")
    shards = max(1, -(-counted.count() // shard_texts))
    return counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int")), shards


def pack_texts(texts: DataFrame, capacity: int, id_: str = "doc_id", text: str = "text", path: str | None = None, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(pack_no, doc_id, piece_no, first_token, n_tokens): every text in packs of ``capacity`` tokens.

    A text longer than the capacity is cut into full packs and one rest that is packed like a text; no other text is
    divided. A null or empty text is a piece of no tokens in some pack. Every row is packed, repeated ones too;
    rows without an id are left out; an empty table gives no rows. ``path`` names the tokenizer's vocabulary file.
    """
    return pack_sizes(texts, {0: capacity}, id_, text, path, shard_texts).drop("pack_id")


def pack_sizes(texts: DataFrame, capacities: dict[int, int], id_: str = "doc_id", text: str = "text", path: str | None = None, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(pack_id, pack_no, ...): the texts packed once for each of a few capacities (by pack_id), tokens counted once.

    Otherwise as :func:`pack_texts`; each pair of shard and capacity is a task of its own.
    """
    if min(capacities.values(), default=1) < 1:
        raise ValueError("a pack holds at least one token")
    dealt, shards = _dealt(texts, id_, text, path, shard_texts)
    each = dealt.withColumn("pack_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in capacities]))) if capacities else dealt.withColumn("pack_id", F.lit(0).cast("bigint")).limit(0)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        at = int(rows["pack_id"].iloc[0])
        out = _pack(rows, capacities[at])
        out.insert(0, "pack_id", at)
        return out

    # A fixed number of tasks, as few bytes would else be put into one.
    tasks = each.repartition(2 * shards * max(1, len(capacities)), "pack_id", "shard")
    return tasks.groupBy("pack_id", "shard").applyInPandas(pack, "pack_id long, " + _PIECE)
