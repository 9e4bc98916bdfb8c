"""Merging of duplicates: pairs in greedy order, no cluster used twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A title longer by more than this makes its cluster the primary one.
DETAIL = 30
#: Rounds of the greedy selection at most; each one about halves what is left, as ties are broken by hash.
ROUNDS = 200


def primary_first(pairs: DataFrame) -> DataFrame:
    """primary, duplicate, points of pairs a, b with points: the smaller title_id is primary, unless the other's title is longer by over DETAIL characters."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    first = a("title_id") < b("title_id")
    older, newer = F.when(first, a("title_id")).otherwise(b("title_id")), F.when(first, b("title_id")).otherwise(a("title_id"))
    length = lambda x: F.length(F.coalesce(x("title"), F.lit("")))
    more = F.when(first, length(b) - length(a)).otherwise(length(a) - length(b)) > DETAIL
    return pairs.select(F.when(more, newer).otherwise(older).alias("primary"), F.when(more, older).otherwise(newer).alias("duplicate"), "points")


def greedy(pairs: DataFrame, written: Callable[[DataFrame, str], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """primary, duplicate, points of the pairs that a greedy pass takes: by falling points, each cluster in one merge at most.

    pairs: primary, duplicate, points; of rows that repeat a pair the highest points count; pairs with a null or of one
    cluster with itself take no part. Equal points are ordered by the MD5 of the two ids, then by the ids, so that no long
    chains of ties arise. A pair that is the best one of both its clusters is taken by the sequential pass whatever else
    happens; each round takes all these and drops the pairs of the clusters used. The first of all remaining pairs is always
    among them, so the loop ends. written(df, name) puts a table into the shared folder; nothing is collected.
    """
    ids = [F.col(c).cast("string") for c in ("primary", "duplicate")]
    known = pairs.where(F.col("points").isNotNull() & (F.col("primary") != F.col("duplicate"))).groupBy("primary", "duplicate").agg(F.max("points").alias("points"))
    order = F.struct((-F.col("points")).alias("points"), F.md5(F.concat_ws("-", *ids)).alias("tie"), "primary", "duplicate")
    left = written(known.select(order.alias("pair")), "pairs-left")
    taken = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        ends = left.select("pair", F.explode(F.array("pair.primary", "pair.duplicate")).alias("cluster"))
        best = ends.groupBy("cluster").agg(F.min("pair").alias("pair"))
        mutual = written(best.groupBy("pair").agg(F.count("*").alias("n")).where("n = 2").select("pair"), "pairs-taken")
        taken = mutual if taken is None else taken.unionByName(mutual)
        used = mutual.select(F.explode(F.array("pair.primary", "pair.duplicate")).alias("used"))
        for side in ("primary", "duplicate"):
            left = left.join(used, F.col(f"pair.{side}") == F.col("used"), "left_anti")
        left = written(left, "pairs-left")
    else:
        raise RuntimeError(f"pairs left after {rounds} rounds")
    found = left if taken is None else taken
    return found.select("pair.primary", "pair.duplicate", (-F.col("pair.points")).alias("points"))
