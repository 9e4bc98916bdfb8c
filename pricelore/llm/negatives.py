"""Hard negatives by exact search in k-means inverted lists, pruned by Cauchy-Schwarz bounds on their centroids' radii."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelore.llm.common import written

#: Centroids, the vectors that they are fitted on at most (a sample by hash), and passes of the fit.
CENTROIDS, SAMPLE, PASSES = 64, 8_192, 8
#: Rows of a piece of a list on average, queries of a block that meets a piece in one task, and of those that are scored at once.
PIECE, BLOCK, AT_ONCE = 4_096, 16_384, 512
#: Limits of scores where there are none.
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Lists that each query visits first; the others follow only where their bound reaches the kth score.
FIRST = 8
#: Components are cut to this size, so that inner products stay exact in longs.
LARGEST = 1 << 26


def integral(df: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, vector (floor(scale * x) as longs) of the rows that take part, one for each vec_id."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("vector", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))))
    return rows.select("vec_id", "label", whole.alias("vector")).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own")).select("vec_id", "own.*")


def centroids(vectors: np.ndarray, k: int, passes: int) -> np.ndarray:
    """K-means by Lloyd's passes from the first k different vectors; centroids that lose all vectors stay."""
    centers = np.unique(vectors, axis=0)
    centers = centers[np.linspace(0, len(centers) - 1, min(k, len(centers))).astype(int)].astype(np.float64)
    for _ in range(passes):
        own = nearest(vectors, centers)
        n = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, vectors)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1)[None, :] - 2 * vectors @ centers.T, axis=1)


class Lists:
    """Inverted lists: every row in the list of its nearest centroid, lists in pieces, and each list's radius."""

    def __init__(self, rows: DataFrame, k: int = CENTROIDS, sample: int = SAMPLE, passes: int = PASSES, piece: int = PIECE):
        self.rows = written(rows, "integral-vectors")
        self.size = self.rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if self.size is None:
            return
        self.rows = self.rows.where(F.size("vector") == self.size.d)
        fitted = self.rows.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        self.centers = centers = centroids(np.array([r.vector for r in fitted], dtype=np.float64).reshape(len(fitted), -1), k, passes)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    vectors = matrix(batch.column(2).to_pylist()).astype(np.float64)
                    own = nearest(vectors, centers)
                    far = np.sqrt(((vectors - centers[own]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], names=["vec_id", "label", "vector", "list", "far"])

        lists = self.rows.select("vec_id", "label", "vector").mapInArrow(assigned, "vec_id long, label long, vector array<long>, list int, far double")
        self.lists = written(lists, "inverted-lists")
        stored = self.lists.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()  # a row for each centroid
        self.radius = {r.list: r.radius for r in stored}
        self.pieces = {r.list: -(-r.n // piece) for r in stored}

    def n_pieces(self) -> Column:
        """Pieces of the list in column list: long lists, such as those of a vector with many copies, are cut by hash."""
        return F.element_at(F.create_map(*[F.lit(x) for pair in self.pieces.items() for x in pair]), F.col("list"))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """key, list, bound, nth for each query (key, vector, low, high) and list that can hold scores from low to high.

        No score of a list differs from the query's with the centroid by more than the query's length times the radius
        (Cauchy-Schwarz). nth: the list's place by falling upper bound.
        """
        used = sorted(self.radius)
        centers, radius = self.centers[used], np.array([self.radius[i] for i in used])
        number = np.array(used, dtype=np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = matrix(batch.column(1).to_pylist()).astype(np.float64)
                middle = vectors @ centers.T
                reach = np.sqrt((vectors**2).sum(1))[:, None] * radius[None, :]
                slack = 1e-9 * (np.abs(vectors) @ np.abs(centers).T + reach) + 1e-6  # rounding never makes a bound too tight
                upper, lower = middle + reach + slack, middle - reach - slack
                low, high = (batch.column(i).to_numpy().astype(np.float64)[:, None] for i in (2, 3))
                meets = (upper >= low) & (lower <= high)
                order = np.argsort(-upper, axis=1, kind="stable")
                query, place = np.nonzero(np.take_along_axis(meets, order, axis=1))
                nth = np.concatenate([np.arange(n) for n in np.bincount(query, minlength=len(vectors))]).astype(np.int32)
                at = order[query, place]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(query)), pa.array(number[at]), pa.array(upper[query, at]), pa.array(nth)], names=["key", "list", "bound", "nth"])

        return queries.select("key", "vector", "low", "high").mapInArrow(run, "key string, list int, bound double, nth int")

    def search(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        """key, rank (from 1), vec_id, score of the k highest inner products from low to high; equal ones by smaller vec_id.

        queries: key (string, one for each), own (the vec_id that takes no part), label, vector, low and high.
        Rows have the query's label, or another one. Lists are visited by falling bound, FIRST of them at once; of the others,
        in a second wave, those whose bound isn't strictly below the kth score.
        """
        queries = written(queries.select("key", "own", "label", "vector", "low", "high"), "list-queries")
        bounds = written(self.bounds(queries), "list-bounds")
        one = written(top(self.visited(queries, bounds.where(F.col("nth") < FIRST), k, same_label), k), "first-lists")
        kth = one.where(F.col("rank") == k).select("key", F.col("score").alias("kth"))
        more = bounds.where(F.col("nth") >= FIRST).join(kth, "key", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        two = self.visited(queries, more.select("key", "list"), k, same_label)
        return top(one.select("key", "vec_id", "score").unionByName(two), k)

    def visited(self, queries: DataFrame, visits: DataFrame, k: int, same_label: bool) -> DataFrame:
        """key, vec_id, score: of each piece of the lists in visits (key, list) the k best for each query."""
        blocks = max(1, -(-queries.count() // BLOCK))
        asked = queries.join(visits.select("key", "list"), "key").withColumn("piece", F.explode(F.sequence(F.lit(0), (self.n_pieces() - 1).cast("int"))))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        rows = self.lists.withColumn("piece", F.pmod(F.xxhash64("vec_id"), self.n_pieces()).cast("int"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple[np.ndarray, ...]] = []
            if len(q) and len(x):
                x = x.sort_values("vec_id", kind="stable")
                ids, labels, vectors = x["vec_id"].to_numpy(), x["label"].to_numpy(), matrix(x["vector"])
                for at in range(0, len(q), AT_ONCE):
                    part = q.iloc[at : at + AT_ONCE]
                    scores = products(matrix(part["vector"]), vectors)
                    for key, own, label, low, high, score in zip(part["key"], part["own"], part["label"], part["low"], part["high"], scores, strict=True):
                        fits = ((labels == label) == same_label) & (ids != own) & (score >= low) & (score <= high)
                        at_ids, score = ids[fits], score[fits]
                        best = np.argsort(-score, kind="stable")[:k]
                        found += zip([key] * len(best), at_ids[best].tolist(), score[best].tolist(), strict=True)
            return pd.DataFrame(found, columns=["key", "vec_id", "score"])

        where = ["list", "piece", "block"]
        return asked.groupBy(where).cogroup(rows.groupBy(where)).applyInPandas(meet, "key string, vec_id long, score long")


def matrix(vectors) -> np.ndarray:
    """The vectors as rows of longs."""
    vectors = list(vectors)
    return np.array([np.asarray(v, dtype=np.int64) for v in vectors], dtype=np.int64).reshape(len(vectors), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as exact longs: in doubles where no partial sum can pass 2**53, else in longs."""
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each key; Spark ranks within tasks first, so that a key has k rows of each task at most."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(df: DataFrame, anchors: Column, k_positive: int = 5, k_negative: int = 10, low: int = 30, high: int = 90, relabel: Column | None = None, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **lists: int) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score for each anchor and positive.

    anchors: condition on vec_id. relabel: the label to use instead of column label, in terms of vec_id and label. Scores
    are inner products of floor(scale * x), exact; higher come first, equal ones by smaller vec_id. Positives are an
    anchor's first k_positive other rows of its label; negatives the first k_negative rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Rows with a null vec_id, label or vector, or a
    null or non-finite component take no part, nor do vectors of another length than most; of rows that repeat a vec_id the
    one with the smallest label, then vector, counts. Components beyond LARGEST are cut to it. Columns of other names are
    ignored; no rows, no anchors or no positives give no rows.
    """
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = Lists(integral(df.withColumn(label, relabel) if relabel is not None else df, vec_id, vector, label, scale), **lists)
    if index.size is None:
        return df.sparkSession.createDataFrame([], out)
    asked = index.rows.where(anchors).select(F.col("vec_id").cast("string").alias("key"), F.col("vec_id").alias("own"), "label", "vector", F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
    positives = index.search(asked, k_positive, True).select("key", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = positives.join(asked.select("key", F.col("own").alias("anchor_id"), "label", "vector"), "key")
    pairs = written(pairs.withColumn("key", F.concat_ws("/", "key", "nth")), "anchor-positives")  # each pair is a query of its own
    windows = pairs.where("positive_score >= 0").select("key", F.col("anchor_id").alias("own"), "label", "vector", F.expr(f"(positive_score * {low} + 99) div 100").alias("low"), F.expr(f"positive_score * {high} div 100").alias("high"))
    negatives = index.search(windows, k_negative, False).select("key", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = pairs.select("key", "anchor_id", "positive_id", "positive_score").join(negatives, "key")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
