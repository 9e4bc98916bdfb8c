"""Removal of repeated byte strings by a suffix array that is range-partitioned by sampled splitters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelore.llm.common import written

#: Bytes of a repeated string, and of the grams that anchor suffixes.
LEAST, GRAM = 200, 64
#: Bytes that are hashed at once; rows of a bucket of suffixes at most on average, that are compared at once, and of a gram that are compared in their bucket.
SLICE, BUCKET, CHUNK, HOT = 1 << 18, 65_536, 4_096, 8_192
#: Bits of the second key of a text, and of a block's number of suffixes.
KEY_BITS, SIZE_BITS = 20, 8
#: Steps in which the bytes before a gram are compared across buckets.
STEP = 16
RUNS = "array<struct<begin:long,end:long>>"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes at each place, gram a power of two."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    step, base = 1, 0xD6E8FEB86659FD93
    while step < gram:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % 2**64, 2 * step
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead, back = np.minimum.accumulate(padded, axis=1).ravel(), np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(values) - width + 1], ahead[width - 1 : len(values)])


def pieces(texts: list[bytes], least: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text's number, first place, bytes) of about SLICE bytes; a piece holds the suffixes at its places but the last least - 1."""
    found, size = [], 0
    for number, text in enumerate(texts):
        for first in range(0, len(text) - least + 1, SLICE):
            piece = text[first : first + SLICE + least - 1]
            found.append((number, first, piece))
            size += len(piece)
            if size >= SLICE:
                yield found
                found, size = [], 0
    if found:
        yield found


def blocks_of(texts: list[bytes], least: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of neighbouring suffixes whose first `least` bytes have the same anchor: text's number, first place, number of suffixes, anchor.

    The anchor of a string is the first of the least hashes of the grams inside it, so equal strings have equal anchors,
    wherever they stand, and equal strings at two places of a text are in different blocks.
    """
    width = least - gram + 1
    for part in pieces(texts, least):
        data = np.frombuffer(b"".join(p[2] for p in part), dtype=np.uint8)
        sizes = np.array([len(p[2]) for p in part])
        ends = np.cumsum(sizes)
        hashes = gram_hashes(data, gram)
        anchors = sliding_least(hashes, width)
        piece = np.repeat(np.arange(len(part)), sizes)[: len(anchors)]
        valid = np.arange(len(anchors)) + least <= ends[piece]
        turn = np.ones(len(anchors), dtype=bool)
        # the first of the least grams is another one if it is smaller, or if the last one has just been left behind
        turn[1:] = (anchors[1:] != anchors[:-1]) | (hashes[: len(anchors) - 1] == anchors[:-1]) | (piece[1:] != piece[:-1])
        begin = np.flatnonzero(turn & valid)
        end = np.minimum(np.append(begin[1:], len(anchors)), ends[piece[begin]] - least + 1)
        own = piece[begin]
        first = np.array([p[1] for p in part])[own] + begin - (ends - sizes)[own]
        yield np.array([p[0] for p in part])[own], first, end - begin, anchors[begin]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (its UTF-8 bytes; null: empty) and the text's keys k1, k2: equal texts have equal ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.shiftrightunsigned(F.xxhash64(F.lit(1), "text"), 64 - KEY_BITS).alias("k2"))


def anchors(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """gram: the anchor of each block of suffixes of texts (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, anchor in blocks_of(batch.column(0).to_pylist(), least, gram):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], names=["gram"])

    return texts.select("text").mapInArrow(run, "gram long")


def blocks(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """The blocks of texts (k1, k2, text): gram, body (hash of its bytes), k1, place (its first place, k2 and its number of suffixes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            k1, k2, bodies = (batch.column(i) for i in range(3))
            k1, k2, bodies = k1.to_numpy(), k2.to_numpy(), bodies.to_pylist()
            for number, first, n, anchor in blocks_of(bodies, least, gram):
                body = np.array([xxh3_64_intdigest(bodies[i][a:b]) for i, a, b in zip(number.tolist(), first.tolist(), (first + n + least - 1).tolist(), strict=True)], dtype=np.uint64)
                place = (first << (KEY_BITS + SIZE_BITS)) | (k2[number] << SIZE_BITS) | n
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), body.view(np.int64), k1[number], place)], names=["gram", "body", "k1", "place"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "gram long, body long, k1 long, place long")


def first_of(place: str):
    return F.shiftright(place, KEY_BITS + SIZE_BITS)


def key_of(place: str):
    return F.shiftright(place, SIZE_BITS).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def size_of(place: str):
    return F.col(place).bitwiseAND(F.lit((1 << SIZE_BITS) - 1))


def bodies(texts: DataFrame, wanted: DataFrame, least: int, gram: int) -> DataFrame:
    """gram, body, bytes, at (place of the gram in them) of the blocks in wanted (k1, k2, list: structs of gram, body, first, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found = []
            for k1, k2, text, asked in zip(*batch.columns, strict=True):
                key, last = last, (k1.as_py(), k2.as_py())
                if key == last:  # rows of a text follow each other: the join sorts them
                    continue
                text = text.as_py()
                found += [(x["gram"], x["body"], text[x["first"] : x["first"] + x["n"] + least - 1]) for x in asked.as_py()]
            for at in range(0, len(found), CHUNK):
                part = found[at : at + CHUNK]
                sizes = np.array([len(x[2]) for x in part])
                hashes = gram_hashes(np.frombuffer(b"".join(x[2] for x in part), dtype=np.uint8), gram).view(np.int64)
                block = np.repeat(np.arange(len(part)), sizes)[: len(hashes)]
                inside = np.arange(len(hashes)) + gram <= np.cumsum(sizes)[block]
                hit = np.flatnonzero((hashes == np.array([x[0] for x in part])[block]) & inside)
                own, where = np.unique(block[hit], return_index=True)
                places = (hit[where] - (np.cumsum(sizes) - sizes)[own]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part]), pa.array([x[2] for x in part], pa.binary()), pa.array(places, pa.int32())], names=["gram", "body", "bytes", "at"])

    joined = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "list")
    return joined.mapInArrow(run, "gram long, body long, bytes binary, at int").dropDuplicates(["gram", "body"])


def repeated(data: bytes, at: np.ndarray, least: int) -> np.ndarray:
    """Which of the strings of `least` bytes at these places of data stand at two or more of them, by multikey quicksort.

    A character is eight bytes; all ranges of equal leading characters are split at once by the next one, and only ranges
    of two or more strings go on. Ranges whose next characters are all the same aren't sorted.
    """
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    words = np.zeros(len(padded) - 7, dtype=np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : len(padded) - 7 + i]
    depths = [*range(0, least - 7, 8), *([least - 8] if least % 8 else [])]
    live, begins = np.arange(len(at)), np.zeros(1, dtype=np.int64)
    for depth in depths:
        if not len(live):
            break
        character = words[at[live] + depth]
        sizes = np.diff(np.append(begins, len(live)))
        same = np.logical_and.reduceat(character == np.repeat(character[begins], sizes), begins)
        mixed = np.flatnonzero(np.repeat(~same, sizes))
        if len(mixed):
            rank = np.repeat(np.arange(len(begins)), sizes)
            order = mixed[np.lexsort((character[mixed], rank[mixed]))]
            live[mixed], character[mixed] = live[order], character[order]
            start = np.zeros(len(live), dtype=bool)
            start[begins] = True
            start[1:] |= character[1:] != character[:-1]
            begins = np.flatnonzero(start)
            sizes = np.diff(np.append(begins, len(live)))
            keep = np.repeat(sizes > 1, sizes)
            live, sizes = live[keep], sizes[sizes > 1]
            begins = np.cumsum(sizes) - sizes
    found = np.zeros(len(at), dtype=bool)
    found[live] = len(live) > 1
    return found


def shared(a: bytes, b: bytes) -> int:
    """The length of the common beginning of two strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """The runs of True as (begin, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def compare(rows: list[tuple], least: int) -> list[tuple[int, int, list[dict]]]:
    """gram, body, runs of the suffixes of each block (gram, body, bytes, ...) whose first `least` bytes stand at another place of these blocks."""
    sizes = np.array([len(r[2]) for r in rows])
    n = sizes - least + 1
    block = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hit = repeated(b"".join(r[2] for r in rows), (np.cumsum(sizes) - sizes)[block] + inside, least)
    out = []
    for (gram, body, *_), mine in zip(rows, np.split(hit, np.cumsum(n)[:-1]), strict=True):
        if mine.any():
            out.append((gram, body, [{"begin": a, "end": b} for a, b in runs(mine)]))
    return out


def sorted_blocks(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """gram, body, runs: the repeated suffixes of each block of rows (gram, body, bytes, at), distinct blocks that share their anchors.

    Spark samples the splitters and range-partitions the suffixes that begin at the blocks' grams by their leading bytes. In
    its order a task meets the blocks of a gram one after the other, expands them to all their suffixes and sorts those by
    multikey quicksort. Grams that several buckets hold, and those of over HOT blocks, are compared across the boundaries: of
    their suffixes those that another block can share, by what neighbours in the order share behind the gram and by equal
    beginnings before it, are counted by hashes of 128 bits, with partial sums, over all buckets.
    """
    spark = rows.sparkSession
    count = rows.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // BUCKET))
    suffix = F.expr("substring(bytes, at + 1)")
    ranged = rows.withColumn("suffix", suffix).repartitionByRange(buckets, "suffix").sortWithinPartitions("suffix", "body").select("gram", "body", "bytes", "at")
    names = ["gram", "body", "runs", "bytes", "at", "last", "bucket", "hot"]
    schema = f"gram long, body long, runs {RUNS}, bytes binary, at int, last int, bucket int, hot boolean"
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], names=names)

        def held(group: list[tuple], first: bool, final: bool, known: list[tuple] | None) -> pa.RecordBatch:
            """Rows for other buckets to meet, up to the last suffix of each that another block can share.

            Behind its gram a block shares most with its neighbours in the order; where a neighbour isn't at hand, it may share all.
            """
            hits = {body: found for _, body, found in known or ()}
            tails = [data[at:] for _, _, data, at in group]
            between = [len(tails[0]) if first else 0, *(shared(x, y) for x, y in zip(tails, tails[1:], strict=False)), len(tails[-1]) if final else 0]
            rows = [(g, b, hits.get(b), data, at, at + max(between[i : i + 2]) - least, number, known is None) for i, (g, b, data, at) in enumerate(group)]
            return batch_of([r for r in rows if r[5] >= 0])

        ready: list[tuple] = []
        group: list[tuple] = []
        n_groups, cut = 0, False  # cut: the group goes on from rows that have left
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][0] != row[0]:
                    n_groups += 1
                    if cut:
                        yield held(group, True, False, None)
                    elif n_groups == 1:
                        yield held(group, True, False, compare(group, least))
                    else:
                        ready += group
                    group, cut = [], False
                    if len(ready) >= CHUNK:
                        yield batch_of([(*r, *[None] * 5) for r in compare(ready, least)])
                        ready = []
                group.append(row)
                if len(group) > HOT:  # goes on without being gathered
                    yield held(group[:-1], cut or not n_groups, True, None)
                    group, cut = group[-1:], True
        if group:
            yield held(group, cut or not n_groups, True, None if cut else compare(group, least))
        if ready:
            yield batch_of([(*r, *[None] * 5) for r in compare(ready, least)])

    first = written(ranged.mapInArrow(run, schema), "suffix-buckets")
    held = first.where("bytes is not null")
    wide = held.groupBy("gram").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"), F.bool_or("hot").alias("hot")).where((F.col("a") < F.col("b")) | F.col("hot")).select("gram")

    met = held.join(wide, "gram")
    # before its gram a block shares with some other one less than STEP bytes beyond the longest of these beginnings that two have
    before = met.select("gram", "body", F.expr(f"explode(sequence(0, at, {STEP}))").alias("left"), "bytes", "at")
    before = before.select("gram", "body", "left", F.xxhash64(F.expr("substring(bytes, at - left + 1, left)")).alias("hash"))
    common = before.groupBy("gram", "left", "hash").agg(F.count("*").alias("n")).where("n > 1").select("gram", "left", "hash")
    most = before.join(common, ["gram", "left", "hash"]).groupBy("gram", "body").agg((F.max("left") + STEP - 1).alias("left"))
    met = met.join(most, ["gram", "body"]).select("gram", "body", "bytes", "runs", F.greatest(F.lit(0), F.col("at") - F.col("left")).alias("first"), "last")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            found, seen = [], set()
            for gram_, body, data, hits, begin, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = {i for x in hits or () for i in range(x["begin"], x["end"])}
                for i in range(begin, min(last, len(data) - least) + 1):
                    suffix = xxh3_128_digest(data[i : i + least])
                    if i not in known or suffix not in seen:  # what is known to be repeated is named once, for others to meet
                        found.append((gram_, body, i, suffix, i in known))
                        seen.add(suffix)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["gram", "body", "i", "suffix", "known"])

    single = met.mapInArrow(suffixes, "gram long, body long, i long, suffix binary, known boolean")
    single = written(single, "boundary-suffixes")
    twice = single.groupBy("suffix").agg(F.count("*").alias("n"), F.bool_or("known").alias("known")).where("n > 1 or known").select("suffix")
    across = single.where("not known").join(twice, "suffix").select("gram", "body", F.col("i").alias("begin"), (F.col("i") + 1).alias("end"))
    return first.where("runs is not null").select("gram", "body", F.inline("runs")).unionByName(across)


def repeats(texts: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """k1, k2, runs: where in the texts (k1, k2, text) suffixes begin whose first `least` bytes also stand elsewhere.

    Suffixes come in blocks of neighbours with the same anchor. Anchors that stand once are dropped: no string with such an
    anchor is repeated. Blocks whose bytes are those of another block are repeated as a whole; of the others and of the
    different blocks that share their anchor one of each goes into the suffix array.
    """
    twice = anchors(texts, least, gram).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    found = blocks(texts, least, gram).join(twice, "gram").groupBy("gram", "body", "k1", "place").agg(F.count("*").alias("n"))
    found = written(found, "suffix-blocks")
    distinct = found.groupBy("gram", "body").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "place")).alias("one"))
    distinct = written(distinct, "distinct-blocks")
    shared = distinct.groupBy("gram").agg(F.count("*").alias("n_bodies")).where("n_bodies > 1").select("gram")
    asked = distinct.join(shared, "gram").select("gram", "body", F.col("one.k1").alias("k1"), F.col("one.place").alias("place"))
    asked = asked.select("k1", key_of("place").alias("k2"), F.struct("gram", "body", first_of("place").alias("first"), size_of("place").alias("n")).alias("one"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list("one").alias("list"))
    array = written(bodies(texts, asked, least, gram), "suffix-rows")
    some = sorted_blocks(array, least, gram)
    whole = distinct.where("n > 1").select("gram", "body", F.lit(0).cast("long").alias("begin"), size_of("one.place").alias("end"))
    some = some.join(whole.select("gram", "body"), ["gram", "body"], "left_anti")
    known = written(whole.unionByName(some), "repeated-suffixes")
    hits = found.select("gram", "body", "k1", "place").join(known, ["gram", "body"])
    hits = hits.select("k1", key_of("place").alias("k2"), F.struct((first_of("place") + F.col("begin")).alias("begin"), (first_of("place") + F.col("end")).alias("end")).alias("run"))
    return hits.groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"))


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), spans (begin, end of what was removed) of every row of docs.

    docs: doc_id, text; further columns are ignored. A text counts as its UTF-8 bytes, a null one as empty. Each byte goes
    that a string of `least` bytes covers which also starts anywhere else, in the same text or another row's; strings are
    those of the input. Shorter texts stay as they are; rows that repeat a text of `least` bytes or more lose all of it.
    Rows with null or repeated ids are rows like others; no rows give no rows. kept is binary, as a cut may fall inside a
    letter. gram: a power of two, at most half of `least`.
    """
    if least < 8 or gram > least // 2 or gram & (gram - 1) or least - gram + 1 >= 1 << SIZE_BITS:
        raise ValueError("gram must be a power of two, at most half of least, and at most 254 bytes below it")
    texts = keyed(docs)
    schema = f"doc_id long, n_bytes long, kept binary, spans {RUNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, sizes = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data, covered = text.as_py(), []
                for begin, end in sorted((x["begin"], x["end"] + least - 1) for x in found.as_py() or ()):
                    if covered and begin <= covered[-1][1]:
                        covered[-1][1] = max(covered[-1][1], end)
                    else:
                        covered.append([begin, end])
                at, parts = 0, []
                for begin, end in covered:
                    parts.append(data[at:begin])
                    at = end
                kept.append(b"".join([*parts, data[at:]]))
                spans.append([{"begin": a, "end": b} for a, b in covered])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    joined = texts.join(repeats(texts, least, gram), ["k1", "k2"], "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(run, schema)
