"""Near-duplicate documents: SimHash fingerprints, linked through tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelore.llm.common import components, written

#: Words in a shingle, seed of its hash, and most differing bits of linked fingerprints.
SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Reference fingerprints whose distances are kept; eight fit in a long.
REFERENCES = 16
#: Blocks of bits; two fingerprints with MOST_BITS differing bits or fewer agree in MOST_BITS - 1 blocks at least.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Groups of fingerprints that agree in two blocks are paired by a join up to this size, beyond it in chunks.
SMALL, CHUNK = 48, 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as a signed long; 0 without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(shingle)), strict=False)] or [b" ".join(words)]
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashed), 1 << 16):
        ones += np.unpackbits(hashed[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp (long) of every row of docs (doc_id, text), with the columns (long) to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *keep)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep)))


def references() -> list[int]:
    """The reference fingerprints: hashes of 0, 1, 2, ... as signed longs."""
    import xxhash

    return [int(np.uint64(xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED)).astype(np.int64)) for i in range(REFERENCES)]


def distance_table(fps: DataFrame) -> DataFrame:
    """fp, d0, d1: the Hamming distances to the references, a byte each."""
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("long") for r in references()]
    packed = []
    for at in range(0, REFERENCES, 8):
        column = distance[at]
        for i in range(1, 8):
            column = column.bitwiseOR(F.shiftleft(distance[at + i], 8 * i))
        packed.append(column.alias(f"d{at // 8}"))
    return fps.select("fp", *packed)


def within(a: str, b: str, most: int) -> Column:
    """No distance to a reference differs by more than `most`, and neither do the fingerprints."""
    checks = F.lit(True)
    for i in range(REFERENCES):
        byte = [F.shiftright(F.col(f"{x}.d{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(127)) for x in (a, b)]
        checks = checks & (F.abs(byte[0] - byte[1]) <= most)
    return checks & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= most)


def forest(fp: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within `most` bits connect, fewer than there are fingerprints."""
    near = np.ones((len(fp), len(fp)), dtype=bool)
    for column in table.T.astype(np.int16):
        near &= np.abs(column[:, None] - column[None, :]) <= most
    left, right = np.nonzero(near)
    keep = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= most
    left, right = left[keep], right[keep]
    label = np.arange(len(fp))
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """u, v: links between different fingerprints that connect exactly what all pairs within `most` bits connect.

    fps: fp (long, distinct). Two such fingerprints agree in two of the five BLOCKS, so pairs are sought among those that
    share two blocks' bits. A pair whose distances to some reference differ by more than `most` is discarded (triangle
    inequality); the others are verified. Groups over SMALL are cut into chunks of about CHUNK; every two chunks meet in
    a task, which returns a spanning forest instead of all pairs. No group is gathered in one place.
    """
    if most > 3:
        raise ValueError("five blocks find pairs of at most 3 differing bits")
    table = distance_table(fps)
    keys = []
    for n, (x, y) in enumerate(combinations(BLOCKS, 2)):
        mask = sum(((1 << size) - 1) << begin for begin, size in (x, y))
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("blocks"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
    keyed = table.select("fp", "d0", "d1", F.explode(F.array(*keys)).alias("key")).select("key.blocks", "key.bits", "fp", "d0", "d1")
    sizes = keyed.groupBy("blocks", "bits").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["blocks", "bits"])
    small = shared.where(F.col("n") <= SMALL)
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.blocks") == F.col("b.blocks")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") < F.col("b.fp")) & within("a", "b", most))
    pairs = pairs.select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))

    large = shared.where(F.col("n") > SMALL).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    large = large.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    large = large.select("blocks", "bits", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp", "d0", "d1")

    def meet(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy()
        distances = np.stack([group["d0"].to_numpy(), group["d1"].to_numpy()], axis=1).astype("<i8").view(np.uint8).reshape(len(fp), REFERENCES)
        u, v = forest(fp, distances, most)
        return pa.table({"u": u, "v": v})

    return pairs.unionByName(large.groupBy("blocks", "bits", "i", "j").applyInArrow(meet, "u long, v long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that links reach) of every row.

    docs: doc_id, text; further columns are ignored. Words are runs of characters other than ASCII white space, with A-Z
    lower-cased; null and wordless texts have the fingerprint 0, which links like any other. Rows that repeat an id are
    kept. A null id counts for no component_id; a component of null ids alone has a null one. No rows give no rows. Further
    columns (long) come along if named in keep.
    """
    rows = written(fingerprints(docs, shingle, keep), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), most)).withColumnRenamed("node", "fp")
    members = fps.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    members = written(members, "fingerprint-roots")
    least = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = members.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(of, "fp").select("doc_id", hexed, "component_id", *keep)


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near duplicates, with all its columns: that with the smallest doc_id.

    Each row is judged by its own text, also where rows of other texts have its id. Of rows that repeat the smallest id one
    stays: the first by hashes of all columns, which tell rows apart; of equal rows one. Null ids come after all others; where
    a component has no id at all, one row of each of its fingerprints stays. Columns of any name come along untouched. No
    rows give no rows.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"))
    parts = [F.to_json(F.struct(F.col(f"row.`{c}`"))) if "map<" in kind else F.col(f"row.`{c}`") for c, kind in docs.dtypes]
    parts += [F.col(f"row.`{c}`").isNull() for c in docs.columns]
    rows = rows.withColumns({"d1": F.xxhash64(*parts), "d2": F.xxhash64(F.lit(1), *parts)})
    found = near_duplicates(rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "d1", "d2"), keep=("d1", "d2"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("lost "), "fingerprint"))
    place = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "d1", "d2")
    first = found.groupBy(group.alias("group")).agg(F.min(place).alias("place")).select("place.d1", "place.d2")
    return rows.join(first, ["d1", "d2"]).dropDuplicates(["d1", "d2"]).select("row.*")
