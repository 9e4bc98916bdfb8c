"""Approximate nearest neighbours by a permutation index: pivots' inverted files, footrule distance, reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelore.llm.common import written

#: Pivots (a sample of so many vectors by a hash of their values), and nearest pivots that a vector is posted under.
PIVOTS, NEAREST = 128, 48
#: Vectors in a shard of the index, and queries in a block.
SHARD, BLOCK = 1_024, 1_024
#: Pairs whose cosines are worked out at once.
PAIRS = 65_536
#: Share of a shard that a query reranks, and the least number.
CANDIDATES, LEAST = 0.4, 64


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part: an id, and finite components that aren't all zero."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with that of b: sums in the order of the components, whatever rows stand beside it."""
    # by powers of two, which rounds nothing and keeps squares in range
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) for x in (a, b))
    product, square, other = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        product += x * y
        square += x * x
        other += y * y
    return product / np.sqrt(square * other)


def permutations(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first, ties to the smaller number."""
    return np.argsort(-(unit(vectors) @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int16)


def footrule(queries: np.ndarray, order: np.ndarray, n_pivots: int) -> Iterator[np.ndarray]:
    """For each query's permutation the footrule distances to all of `order`, by the pivots' inverted files.

    A pivot beyond the posted ones counts as standing right after the last. The distance adds, over the query's pivots,
    how far they stand apart; only the postings of the query's pivots are read.
    """
    nearest = order.shape[1]
    pivot = order.ravel()
    by = np.argsort(pivot, kind="stable")
    vector, position = (by // nearest).astype(np.int32), (by % nearest).astype(np.int32)
    ends = np.searchsorted(pivot[by], np.arange(n_pivots + 1))
    for own in queries:
        nearness = np.zeros(len(order), dtype=np.int32)
        for at, p in enumerate(own.tolist()):
            post = slice(ends[p], ends[p + 1])
            nearness[vector[post]] += (nearest - at) - np.abs(position[post] - at)
        yield -nearness


def search(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, nearest: int = NEAREST, candidates: float = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine, among all rows of df but the query's own.

    queries: rows of the same kind; both have columns vec_id and vector. Vectors that are null, zero, of another length
    than most, or hold null or non-finite components take no part, nor do rows without id; rows that repeat both id and
    vector count once. The sample of pivots is bounded; every vector is indexed: it is posted under its nearest pivots in
    the inverted files of its shard. Queries meet the shards in blocks. In each shard a query's vectors are ranked by
    footrule distance and the nearest share is reranked by cosine in double precision; the shards' nearest are merged.
    Scores are worked out pair by pair from the original vectors, always in the same order, so that equal vectors have equal
    scores in whatever shard they are; equal scores go to the smaller vec_id. No queries or no vectors give no rows.
    """
    base, asked = written(valid(df, vec_id, vector).distinct(), "vectors"), written(valid(queries, vec_id, vector).distinct(), "queries")
    by_size = base.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if by_size is None:
        return empty
    same = F.size("vector") == by_size.d
    base, asked = base.where(same), asked.where(same)
    sample = base.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(pivots).collect()
    pivot = unit(np.array([r.vector for r in sample]))
    nearest = min(nearest, len(pivot))
    shards = max(64, -(-base.count() // SHARD))
    blocks = max(1, -(-asked.count() // BLOCK))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = np.stack([x for x in batch.column(1).to_numpy(zero_copy_only=False)])
                order = permutations(vectors, pivot, nearest)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order.astype(np.int32)))], names=["vec_id", "vector", "pivots"])

    schema = "vec_id long, vector array<double>, pivots array<int>"
    index, asked = base.mapInArrow(posted, schema), asked.mapInArrow(posted, schema)
    index = index.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    n_pivots = len(pivot)

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x = x.sort_values("vec_id", kind="stable")
        ids, vectors = x["vec_id"].to_numpy(), np.stack(x["vector"].to_list())
        units, own = unit(vectors), np.stack(q["vector"].to_list())
        order, query_ids, hits = np.stack(x["pivots"].to_list()), q["vec_id"].to_numpy(), []
        many = min(len(ids), max(LEAST, int(np.ceil(candidates * len(ids)))))
        for query_id, asked_unit, far in zip(query_ids.tolist(), unit(own), footrule(np.stack(q["pivots"].to_list()), order, n_pivots), strict=True):
            near = np.flatnonzero(far <= np.partition(far, many - 1)[many - 1])  # all at the same distance as the last
            near = near[ids[near] != query_id]
            rough = units[near] @ asked_unit
            if len(near) > k:  # what can be among the first k once rounding is put right
                near = near[rough >= np.partition(rough, -k)[-k] - 1e-9]
            hits.append(near)
        query, near = np.repeat(np.arange(len(hits)), list(map(len, hits))), np.concatenate(hits)
        score = np.concatenate([cosines(vectors[near[i : i + PAIRS]], own[query[i : i + PAIRS]]) for i in range(0, len(near), PAIRS)] or [np.zeros(0)])
        best = np.lexsort((ids[near], -score, query))
        begin = np.searchsorted(query[best], np.arange(len(hits)))
        best = best[np.arange(len(best)) - begin[query[best]] < k]
        return pd.DataFrame({"query_id": query_ids[query[best]], "vec_id": ids[near[best]], "score": score[best]})

    near = asked.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInPandas(meet, "query_id long, vec_id long, score double")
    ranked = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.far")).alias("score"))
