"""Exact top-k by inner product, a block of rows at a time.

Rows in order of their ids form blocks, each with its forward index (its vectors) and the largest
and smallest value of every term. For a query, the sum of its terms' best values in a block
bounds every score there. A cell meets some queries with some blocks: each query takes the blocks
by falling bound and stops once the bound is below its k-th score. The best of all cells are
merged. Queries and blocks are dealt evenly to the cells of a
grid, so that both sides of a cell have a set size, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import materialize

#: Rows of a block, blocks of a cell and queries of a cell.
BLOCK_ROWS, CELL_BLOCKS, CELL_QUERIES = 512, 32, 2048
#: Sums of whole numbers below this are exact in float64.
_EXACT = 2.0**53


def whole_terms(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as double; null if any is null or not finite."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, scaled)


def _blocks(rows: DataFrame, terms: int, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows of (id, terms): ids, vectors, and limits of each term."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                while len(part):
                    held.append(part.iloc[: size - count])
                    part = part.iloc[size - count :]
                    count += len(held[-1])
                    if count == size:
                        yield block(pd.concat(held))
                        held, count = [], 0
        if count:
            yield block(pd.concat(held))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.zeros((len(frame), terms))
        for row, values in zip(vectors, frame["terms"], strict=True):
            row[: len(values)] = values
        made = {
            "ids": frame["id"].to_numpy(np.int64).tobytes(),
            "vectors": vectors.tobytes(),
            "most": vectors.max(axis=0).tobytes(),
            "least": vectors.min(axis=0).tobytes(),
        }
        return pd.DataFrame({k: [v] for k, v in made.items()})

    return rows.mapInPandas(pack, "ids binary, vectors binary, most binary, least binary")


def _matrix(raw: bytes, terms: int, exact: bool) -> np.ndarray:
    found = np.frombuffer(raw).reshape(-1, terms)
    return found if exact else np.vectorize(int, otypes=[object])(found)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _best(
    queries: tuple[np.ndarray, np.ndarray], blocks: pd.DataFrame, k: int, terms: int, exact: bool
) -> pd.DataFrame:
    """The k best rows of some blocks for each query: query_id, vec_id, score."""
    own, wanted = queries
    plus, minus = np.maximum(wanted, 0), np.minimum(wanted, 0)
    limits = [
        plus @ _matrix(top, terms, exact)[0] + minus @ _matrix(low, terms, exact)[0]
        for top, low in zip(blocks["most"], blocks["least"], strict=True)
    ]
    bounds = np.stack(limits, axis=1)
    order = np.argsort(-bounds, axis=1, kind="stable")
    number = np.zeros(0, np.int64)  # of the query, for each row found so far
    ids, scores = np.zeros(0, np.int64), np.zeros(0, wanted.dtype)
    kth = np.full(len(own), -np.inf) if exact else np.full(len(own), -(2**4000), object)
    every = np.arange(len(own))
    for step in range(bounds.shape[1]):
        block_of = order[:, step]
        open_ = bounds[every, block_of] >= kth
        if not open_.any():
            break
        new = [(number, ids, scores)]
        for b in np.unique(block_of[open_]):
            asking = np.flatnonzero(open_ & (block_of == b))
            found = wanted[asking] @ _matrix(blocks["vectors"].iloc[b], terms, exact).T
            there = np.frombuffer(blocks["ids"].iloc[b], np.int64)
            good = (found >= kth[asking][:, None]) & (there[None, :] != own[asking][:, None])
            q, r = np.nonzero(good.astype(bool))
            new.append((asking[q], there[r], found[q, r]))
        number, ids, scores = (np.concatenate(x) for x in zip(*new, strict=True))
        rank = np.lexsort((ids, -scores if exact else [-s for s in scores], number))
        number, ids, scores = number[rank], ids[rank], scores[rank]
        first = np.searchsorted(number, every)
        keep = np.arange(len(number)) - first[number] < k
        number, ids, scores = number[keep], ids[keep], scores[keep]
        sizes = np.bincount(number, minlength=len(own))
        full = np.flatnonzero(sizes == k)
        kth[full] = scores[np.cumsum(sizes)[full] - 1]
    low, high = -(2**63), 2**63 - 1
    whole = scores.astype(np.int64) if exact else [min(max(s, low), high) for s in scores]
    return pd.DataFrame({"query_id": own[number], "vec_id": ids, "score": whole})


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    scale: float = 64.0,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query.

    Components are floor(scale * x). ``queries`` is a condition on the rows' columns. Candidates
    of a query are all rows with another id; ties go to the smaller id. Vectors that are null,
    hold null or non-finite components, or have a null id take no part. Shorter vectors count as
    filled up with zeros. Rows with a repeated id are candidates each; as a query, the id asks once,
    with its smallest vector. Components and scores beyond 64 bits
    stop there. An empty table gives no rows.
    """
    chosen = vectors.select(
        vectors[id].cast("bigint").alias("id"),
        whole_terms(vectors[vector], scale).alias("terms"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    )
    rows = materialize(chosen.filter("id IS NOT NULL AND terms IS NOT NULL"), "topk-rows")
    asking = rows.filter("asks").groupBy("id").agg(F.min("terms").alias("terms"))
    largest = F.max(F.array_max(F.transform("terms", F.abs)))
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.when(F.col("asks"), F.col("id"))).alias("queries"),
        F.max(F.size("terms")).alias("terms"),
        largest.alias("largest"),
    ).first()
    terms = max(counts["terms"] or 0, 1)
    exact = (counts["largest"] or 0.0) ** 2 * terms < _EXACT
    parts = max(1, math.ceil(counts["rows"] / (BLOCK_ROWS * CELL_BLOCKS)))
    chunks = max(1, math.ceil(counts["queries"] / CELL_QUERIES))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id").select("id", "terms")
    blocks = materialize(_blocks(ordered, terms, BLOCK_ROWS), "topk-blocks")
    groups = max(1, math.ceil(blocks.count() / CELL_BLOCKS))
    dealt = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")
    spread_queries = asking.select(
        "id", "terms", dealt.alias("chunk"), F.explode(_numbers(groups)).alias("cell")
    )
    spread_blocks = blocks.withColumn(
        "cell", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")
    ).withColumn("chunk", F.explode(_numbers(chunks)))

    def cell(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(there):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        wanted = np.zeros((len(asking), terms))
        for row, values in zip(wanted, asking["terms"], strict=True):
            row[: len(values)] = values
        queries = asking["id"].to_numpy(np.int64), _matrix(wanted.tobytes(), terms, exact)
        return _best(queries, there, k, terms, exact)

    found = (
        spread_queries.groupBy("chunk", "cell")
        .cogroup(spread_blocks.groupBy("chunk", "cell"))
        .applyInPandas(cell, "query_id bigint, vec_id bigint, score bigint")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
