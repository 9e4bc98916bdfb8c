"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"
#: Bytes of texts that are encoded together, and at most one text more.
BLOCK_BYTES = 8 << 20


def write_tokens(docs: DataFrame, path: str, encode: Callable[[list[str | None]], list[bytes]], end_id: int = 2, stripe_bytes: int = 16 << 20, stride: int = 1000) -> None:
    """Writes each document's ids, with end_id after them, as ORC files in ascending doc_id order.

    docs: doc_id, text (null: empty); further columns are ignored. Null ids come first; rows of one id are in the order of
    their text's hash. Columns of the files: part (number of the file's range of ids), doc_id, part_start (ids of the
    part before the document), n_tokens, ids. Strings of ids are stored by ORC's integer run-length encoding; each
    stripe has a row index every `stride` rows and a Bloom filter on doc_id.
    """
    end = int(end_id).to_bytes(4, "little")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begin = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = (np.flatnonzero(np.diff(sizes // BLOCK_BYTES)) + 1).tolist()
            for at, to in pairwise([0, *cuts, batch.num_rows] if batch.num_rows else []):
                ids = [x + end for x in encode(batch.column(1).slice(at, to - at).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(n)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                columns = [pa.array(np.full(len(n), part, np.int32)), batch.column(0).slice(at, to - at), pa.array(begin + ends - n), pa.array(n), lists]
                begin += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = ranged.mapInArrow(run, SCHEMA).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    out.option("orc.row.index.stride", stride).option("orc.stripe.size", stripe_bytes).option("orc.compress", "ZSTD").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of such files: doc_id, start (ids of all documents before it), n_tokens, ids.

    Tasks read stripes side by side. start needs each part's sum, which is gathered from the files' small columns: as
    many numbers as there are parts. A filter on doc_id reaches the files and skips stripes and row groups.
    """
    files = spark.read.schema(SCHEMA).orc(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens")).collect()
    bases, begin = [], 0
    for part, n in sorted(tuple(x) for x in sums):
        bases.append((part, begin))
        begin += n
    base = spark.createDataFrame(bases, "part int, base long")
    return files.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            raw, at = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)).cast("B"), lists.offsets.to_numpy() * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
