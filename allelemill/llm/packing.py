"""Filling containers of fixed capacity with texts of varying length.

Method: sum-of-squares online packing. The state is an array that counts the partly filled containers at each fill
level; a text goes to the level (or into a new container) for which the sum of the squared counts becomes smallest, of
equals to the fullest. A text is split only if it exceeds the capacity: into full containers and one rest.

Texts are dealt to shards by a hash, each with about ``shard_tokens`` tokens and at most about ``shard_items`` texts, and
every shard is packed on its own, so no task grows with the data. What remains in containers filled to less than ``full``
is packed once more, in shards of the same size that hold texts of many former ones, again and again until one shard is
left or less than a twentieth of the texts find a better place.

Defined results: null and empty texts have no tokens and take no place; rows without doc_id are no documents. Repeated texts are each placed. A capacity that
is null or not positive is no limit. Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import cut, ship
from .tokens import TOKENIZER, sizes


def pack(items: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers); items are sizes from 1 to capacity, placed in the order given."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # the level array
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(items), dtype=np.int64)
    n = 0
    for i, s in enumerate(items):
        s = int(s)
        top = capacity - s
        # growth of the sum of squares: a level loses one container, another gains one
        cost = np.where(count[: top + 1] > 0, 2 * (count[s : capacity + 1] - count[: top + 1]) + 2, np.iinfo(np.int64).max)
        if count[top]:
            cost[top] = 1 - 2 * count[top]  # exactly full: full containers are not counted
        cost[0] = 2 * count[s] + 1 if s < capacity else 0  # a new container
        best = top - int(cost[::-1].argmin())
        if best and count[best]:
            at = open_at[best].pop()
            count[best] -= 1
        else:
            at, best, n = n, 0, n + 1
        where[i] = at
        if best + s < capacity:
            open_at[best + s].append(at)
            count[best + s] += 1
    return where, n


def _pieces(df: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, capacity, doc_id, part_no, n_tokens): a text that exceeds the capacity in full parts and a rest."""
    lim = limits.filter("capacity_tokens > 0 and limit_name is not null").select("limit_name", F.col("capacity_tokens").cast("int").alias("capacity"))
    caps = json.dumps([r.asDict() for r in lim.collect()])  # a parameter table; every text gets a place for each of its rows
    each = F.from_json(F.lit(caps), "array<struct<limit_name:string,capacity:int>>")
    x = df.filter("n_tokens > 0").select("doc_id", "n_tokens", F.explode(each).alias("l")).select("doc_id", "n_tokens", "l.*")
    parts = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int")
    x = x.select("limit_name", "capacity", "doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(1), parts)).alias("i", "part_no"))
    return x.select("limit_name", "capacity", "doc_id", "part_no", F.least("capacity", F.col("n_tokens") - F.col("i") * F.col("capacity")).cast("int").alias("n_tokens"))


_SCHEMA = "limit_name string, capacity int, doc_id long, part_no int, n_tokens int, container_id string, fill int"


def _packed(items: DataFrame, shards: int, level: int) -> DataFrame:
    """Each shard of each limit packed on its own; doc order in a shard is by hash, so the result is repeatable."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["order", "doc_id", "part_no"], kind="stable")
        where, n = pack(pdf["n_tokens"].to_numpy(), capacity)
        fill = np.bincount(where, weights=pdf["n_tokens"], minlength=n).astype(int)
        ids = np.array([f"{key[0]}-{level}-{key[1]}-{k}" for k in range(n)], dtype=object)
        return pdf.drop(columns=["order", "shard"]).assign(container_id=ids[where], fill=fill[where])

    h = F.xxhash64("doc_id", "part_no", F.lit(level))
    x = items.select("limit_name", "capacity", "doc_id", "part_no", "n_tokens", h.alias("order"), F.pmod(h, F.lit(shards)).cast("int").alias("shard"))
    ship(items.sparkSession)
    return x.groupBy("limit_name", "shard").applyInPandas(run, _SCHEMA)


def fill_containers(
    documents: DataFrame, limits: DataFrame, path: str = TOKENIZER, shard_tokens: int = 8_000_000, shard_items: int = 50_000, full: float = 0.99
) -> DataFrame:
    """(limit_name, container_id, doc_id, part_no, n_tokens, capacity, fill): every part of every text in its container."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    items = cut(_pieces(sizes(docs, "doc_id", "text", path=path), limits))
    whole = items.filter("n_tokens = capacity").select("*", F.format_string("%s-whole-%d-%d", "limit_name", "doc_id", "part_no").alias("container_id"), F.col("capacity").alias("fill"))
    done, rest = [whole], items.filter("n_tokens < capacity")
    before = math.inf
    for level in count():
        by = rest.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
        most = by.agg(F.max("n").alias("n"), F.max("t").alias("t"), F.sum("n").alias("all")).first()
        if not most["n"]:
            break
        shards = max(1, math.ceil(most["n"] / shard_items), math.ceil(most["t"] / shard_tokens))
        out = cut(_packed(rest, shards, level))
        if shards == 1 or most["all"] > 0.95 * before:
            done.append(out)
            break
        before = most["all"]
        poor = F.col("fill") < F.col("capacity") * full
        done.append(out.filter(~poor))
        rest = out.filter(poor).drop("container_id", "fill")
    res = done[0]
    for d in done[1:]:
        res = res.unionByName(d)
    return res.select("limit_name", "container_id", "doc_id", "part_no", "n_tokens", "capacity", "fill")


def fill_report(placed: DataFrame) -> DataFrame:
    """(limit_name, capacity, n_containers, n_parts, tokens, unused_share, least_containers): least by the tokens alone."""
    per = placed.groupBy("limit_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    r = per.groupBy("limit_name", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("k").alias("n_parts"), F.sum("t").alias("tokens"))
    return r.select("*", (1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity"))).alias("unused_share"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))
