"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelore.llm.common import words_of, written

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are the actual ones to this power: smaller categories gain.
TEMPER = 0.5
#: Share of all tokens that the sample shall have.
BUDGET = 0.8
#: Fitting ends when no margin is off by a larger share of its target; cells are written after so many rounds.
TOLERANCE, ROUNDS = 1e-4, 2
#: Targets count as contradicting each other if a margin is off by more than FAR after EARLY rounds, or isn't met after
#: MOST_ROUNDS. They are then moved towards the actual shares by this much of the way, and again, until they can be met.
EARLY, FAR, MOST_ROUNDS, STEPS = 10, 0.05, 60, 4
#: Cells that are broadcast at most (three short strings and two numbers each); more are joined by salted keys.
BROADCAST_CELLS, SALTS = 20_000, 32


def topic_of(text: Column) -> Column:
    """A coarse topic: legal, list, contact, else note, article or book by length; note for a null text."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return (
        F.when(low.contains("license"), "legal").when(low.contains(" | "), "list").when(low.contains("@") | low.contains("http"), "contact")
        .when(F.length(low) < 1_000, "note").when(F.length(low) < 8_000, "article").otherwise("book")
    )


def raised(margin: DataFrame, total: float) -> float:
    """The level at which min(t, level * raw), summed over the rows (t, raw) of margin, is `total`, or all of t that may be had.

    The sum is concave and piecewise linear in the level, so that Newton's steps from below meet it exactly, in fewer
    steps than there are rows.
    """
    level = 0.0
    while True:
        full = F.col("t") <= level * F.col("raw")
        got = margin.where("raw > 0").agg(F.sum(F.when(full, F.col("t"))), F.sum(F.when(~full, F.col("raw")))).first()
        if not got[1] or (total - (got[0] or 0)) / got[1] <= level * (1 + 1e-12):
            return level
        level = (total - (got[0] or 0)) / got[1]


def margins(cells: DataFrame, targets: dict[str, dict[str, float]] | None, total: float | None, follow: float = 1.0) -> dict[str, DataFrame]:
    """For each dimension a table (dimension, target) of the tokens wanted.

    With a total, no category is asked for more tokens than it has: what one lacks goes to the others in proportion to
    their shares. Without, targets sum to all tokens. follow: how far targets go from the actual shares to the wanted ones.
    """
    spark, found = cells.sparkSession, {}
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    for dim in DIMENSIONS:
        margin = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
        if targets and dim in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[dim].items()], f"{dim} string, raw double")
            margin = margin.join(given, dim, "left").select(dim, "t", F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            margin = margin.select(dim, "t", F.pow("t", F.lit(TEMPER)).alias("raw"))
        margin = written(margin, f"margin-{dim}")
        if total is None:
            scale = margin.agg(F.sum("raw")).first()[0] or 1.0
            found[dim] = margin.select(dim, (F.col("raw") / scale * whole).alias("target"))
        else:
            actual = total / (whole or 1) * F.col("t")
            found[dim] = margin.select(dim, (follow * F.least("t", raised(margin, total) * F.col("raw")) + (1 - follow) * actual).alias("target"))
    return found


def raked(cells: DataFrame, wanted: dict[str, DataFrame], bounded: bool) -> tuple[DataFrame, bool]:
    """Cells with gains scaled by each dimension in turn until all margins are met; whether they were met within MOST_ROUNDS.

    Bounded, a cell counts tokens * min(1, gain): a category's factor is a Newton step on that concave sum. Few cells, after
    a count, are one partition, in which a round needs no shuffle; more are dealt by the dimensions' categories.
    """
    together = (lambda df: df.coalesce(1)) if cells.count() <= BROADCAST_CELLS else (lambda df: df)
    for dim in DIMENSIONS:
        cells = cells.join(wanted[dim].withColumnRenamed("target", f"want_{dim}"), dim, "left")
    names = cells.columns
    cells = together(written(cells, "cells"))
    for done in range(1, MOST_ROUNDS + 1):
        for dim in DIMENSIONS:
            own, want = Window.partitionBy(dim), F.col(f"want_{dim}")
            full = (F.col("gain") >= 1) if bounded else F.lit(False)
            cells = cells.withColumns({"full": F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(own), "free": F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("gain"))).over(own)})
            now = F.col("full") + F.col("free")
            step = F.when((F.col("free") > 0) & (want > F.col("full")), (want - F.col("full")) / F.col("free"))
            step = step.when((F.col("free") == 0) & (want >= now), 1.0).otherwise(want / now)
            miss = F.when(want > 0, F.abs(now / want - 1)).otherwise(F.when(now > 0, 1.0).otherwise(0.0))
            cells = cells.withColumns({"gain": F.when(want.isNotNull() & (now > 0), F.col("gain") * step).otherwise(F.col("gain")), f"off_{dim}": F.coalesce(miss, F.lit(0.0))})
        if done % ROUNDS == 0 or done == MOST_ROUNDS:
            cells = together(written(cells, "cells"))
            now = cells.agg(F.max(F.greatest(*(f"off_{dim}" for dim in DIMENSIONS)))).first()[0] or 0.0
            if now <= TOLERANCE or bounded and done >= EARLY and now > FAR:
                return cells.select(*DIMENSIONS, "tokens", "gain"), now <= TOLERANCE
        cells = cells.select(*names)
    return cells.select(*DIMENSIONS, "tokens", "gain"), False


def fitted(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float | None = None) -> DataFrame:
    """Adds gain and weight to cells (source, lang, topic, tokens): the tokens raked to the target shares of each dimension.

    targets: for a dimension, each category's share (they are scaled to sum to 1 over the categories that have tokens;
    a category left out gets 0). A dimension left out has its actual shares to the power TEMPER, scaled. A cell without
    tokens keeps weight 0. Without a budget, weights sum to all tokens. With one, they sum to that share of all tokens (or
    to all that categories with targets have), and no cell weighs more than it has: the bound is part of the fit, and a
    category wanted larger than it is counts with all it has. Where the dimensions' targets contradict each other, they are
    followed only part of the way from the actual shares (column followed, 1 to 0; at 0 they can be met), but for
    categories left out, which get 0 all the same.
    """
    wanted = F.lit(True)
    for dim, given in (targets or {}).items():
        wanted = wanted & F.col(dim).isin([k for k, v in given.items() if v > 0])
    start = cells.select(*DIMENSIONS, "tokens", F.when(wanted, 1.0).otherwise(0.0).alias("gain"))
    if budget is None:
        found, met = raked(start, margins(cells, targets, None), False)
        if not met:
            raise ValueError("the targets of source, lang and topic contradict each other: no weights of these cells meet them all")
        return found.withColumns({"weight": F.col("tokens") * F.col("gain"), "followed": F.lit(1.0)})
    have = start.where("gain > 0")
    there = have.agg(F.sum("tokens")).first()[0] or 0
    total = min(float(there), budget * (cells.agg(F.sum("tokens")).first()[0] or 0))
    for step in range(STEPS, -1, -1):
        follow = step / STEPS
        found, met = raked(start.withColumn("gain", F.col("gain") * F.lit(total / (there or 1))), margins(have, targets, total, follow), True)
        if met:
            break
    return found.withColumns({"weight": F.col("tokens") * F.least(F.lit(1.0), "gain"), "followed": F.lit(follow)})


def measured(docs: DataFrame) -> DataFrame:
    """source, lang, topic (null as '') and tokens (words) of every row, with doc_id."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    text = F.col("text").cast("string")
    return docs.select("doc_id", name("source"), name("lang"), topic_of(text).alias("topic"), F.size(words_of(text)).cast("long").alias("tokens"), F.xxhash64("doc_id", text).alias("draw"))


def with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Joins rows (source, lang, topic) to their cell's gain and probability. No cell is left out; hot cells are no matter:
    few cells are broadcast, after a count; more are dealt with rows by salted keys."""
    cells = cells.select(*DIMENSIONS, "gain", "followed", F.least(F.lit(1.0), "gain").alias("probability"))
    if cells.count() <= BROADCAST_CELLS:
        return rows.join(F.broadcast(cells), list(DIMENSIONS))
    salted = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.col("draw"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*DIMENSIONS, "salt"]).drop("salt")


def drawn(draw: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that hangs on draw alone."""
    return F.shiftrightunsigned(F.xxhash64(draw, F.lit(seed)), 11) / F.lit(float(2**53))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 0) -> DataFrame:
    """Every row's cell, gain and probability, and whether it is sampled.

    docs: doc_id, text, lang, source; further columns are ignored. Tokens (words) are summed by source, language and topic
    over all rows, and these cells raked to the targets, with the bound that nothing is taken twice (see fitted): the sample's
    expected tokens are `budget` of all and meet each dimension's targets, but that a category counts with all it has where
    more is wanted, and that targets which contradict each other are followed part of the way (column followed). A row is sampled with probability min(1, gain), drawn by a hash of its id and text, so that it comes out
    alike each time; rows that repeat share their lot. Null categories count as ''. Null or wordless texts have no tokens
    and the probability of their cell. No rows give no rows.
    """
    rows = written(measured(docs), "mix-rows")
    cells = fitted(written(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells"), targets, budget)
    out = with_probability(rows, cells)
    return out.select("doc_id", *DIMENSIONS, "tokens", "gain", "probability", "followed", (drawn(F.col("draw"), seed) < F.col("probability")).alias("sampled"))


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 0) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source and any further columns) that mix() samples, with all their columns.

    Nulls, empty texts, repeated rows and empty tables are treated as in mix().
    """
    cells = written(measured(docs).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    cells = fitted(cells, targets, budget)
    text = F.col("text").cast("string")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), name("source"), name("lang"), topic_of(text).alias("topic"), F.xxhash64("doc_id", text).alias("draw"))
    out = with_probability(rows, cells)
    return out.where(drawn(F.col("draw"), seed) < F.col("probability")).select("row.*")
