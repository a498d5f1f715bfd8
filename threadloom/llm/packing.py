"""Filling fixed-capacity containers (problem 8) by sum-of-squares packing.

Sizes are tokens of a public tokenizer, counted once and kept. Documents are dealt to
shards of bounded size by hash; each shard places its documents, longest first, where
the sum over gaps of the squared number of open bins with that gap becomes smallest.
Only (id, size) pairs are shuffled. The room lost per shard is bounded, so it does not
grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.durable import materialise
from threadloom.llm.tokens import DEFAULT_DIR, encoding

#: Documents a shard holds on average; more make packing tighter and tasks longer.
SHARD_DOCS = 50_000


def measure(documents: DataFrame, tokenizer_dir: str = DEFAULT_DIR) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have none. Repeated ids count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer_dir)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    counted = documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "doc_id bigint, n_tokens int")
    return counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, in the order given; sizes lie between 1 and capacity.

    open_bins[g] counts bins with gap g. Putting an item of size s into a bin of gap g
    changes the sum of squares by 2 (open_bins[g - s] - open_bins[g] + 1); closing a bin
    (gap 0) or opening one drops the part of the gap that does not count. Ties go to the
    smallest gap, so the fullest bin.
    """
    open_bins = np.zeros(capacity + 1, dtype=np.int64)
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    n_bins = 0
    for i, s in enumerate(sizes):
        s = int(s)
        best, gap = 2 * open_bins[capacity - s] + 1 if s < capacity else 0, capacity
        if n_bins:
            have = open_bins[s:capacity]
            change = np.where(have > 0, 2 * (open_bins[: capacity - s] - have + 1), np.iinfo(np.int64).max)
            if len(change):
                if have[0] > 0:
                    change[0] = 1 - 2 * have[0]
                k = int(change.argmin())
                if change[k] <= best:
                    gap = k + s
        if gap == capacity:
            b, n_bins = n_bins, n_bins + 1
        else:
            b = at[gap].pop()
            open_bins[gap] -= 1
        out[i] = b
        left = gap - s
        if left:
            at[left].append(b)
            open_bins[left] += 1
    return out


def pack(documents: DataFrame, limits: DataFrame, tokenizer_dir: str = DEFAULT_DIR) -> DataFrame:
    """(limit_id, container_id, doc_id, piece_no, first_token, n_tokens): where every document goes.

    A document longer than the capacity becomes full containers of its own and one rest,
    which is packed like any document. A document without tokens takes no room: its
    container_id is null. *limits* is a table of a few fixed capacities; those that are
    null or below one are ignored. An empty table gives an empty result.
    """
    sizes = materialise(measure(documents, tokenizer_dir), "sizes")
    n_shards = max(1, -(-sizes.count() // SHARD_DOCS))
    wanted = [r for r in limits.select("limit_id", "max_tokens").distinct().take(1001) if r.max_tokens and r.max_tokens > 0]
    if len(wanted) > 1000:
        raise ValueError("more than 1000 capacities")
    each = F.array(*[F.struct(F.lit(r.limit_id).alias("limit_id"), F.lit(r.max_tokens).alias("cap")) for r in wanted]) if wanted else F.array().cast("array<struct<limit_id:int,cap:int>>")
    items = sizes.select("doc_id", "n_tokens", F.explode(each).alias("l")).select("doc_id", "n_tokens", "l.limit_id", "l.cap")
    full = items.select("*", F.floor(F.col("n_tokens") / F.col("cap")).cast("int").alias("n_full"))
    own = full.where("n_full > 0").select("limit_id", "doc_id", "cap", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("piece_no")).select(
        "limit_id",
        F.concat_ws("-", F.lit("d"), "doc_id", "piece_no").alias("container_id"),
        "doc_id",
        "piece_no",
        (F.col("piece_no") * F.col("cap")).cast("bigint").alias("first_token"),
        F.col("cap").alias("n_tokens"),
    )
    rest = full.withColumn("rest", (F.col("n_tokens") % F.col("cap")).cast("int"))
    nothing = rest.where("n_tokens = 0").select(
        "limit_id", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).alias("n_tokens")
    )

    def place(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rest", "doc_id"], ascending=[False, True], kind="stable")
        bins = sum_of_squares(g["rest"].to_numpy(), int(g["cap"].iloc[0]))
        return pd.DataFrame(
            {
                "limit_id": g["limit_id"],
                "container_id": [f"{key[1]}-{b}" for b in bins],
                "doc_id": g["doc_id"],
                "piece_no": g["n_full"],
                "first_token": g["n_full"].astype("int64") * g["cap"],
                "n_tokens": g["rest"],
            }
        )

    dealt = rest.where("rest > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int"))
    packed = dealt.groupBy("limit_id", "shard").applyInPandas(place, "limit_id int, container_id string, doc_id bigint, piece_no int, first_token bigint, n_tokens int")
    return packed.unionByName(own).unionByName(nothing)


def fill(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers used, the least that could do, and the share of room left."""
    per = packed.where("container_id is not null").groupBy("limit_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    got = per.join(limits.select("limit_id", "label", "max_tokens").distinct(), "limit_id")
    least = F.ceil(F.col("n_tokens") / F.col("max_tokens"))
    return got.select("limit_id", "label", "n_containers", least.alias("n_least"), "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("max_tokens"))).alias("room_left"))
