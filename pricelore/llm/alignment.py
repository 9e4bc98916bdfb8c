"""Alignment of two tokenizers' tokens over a corpus: groups of tokens that cover the same bytes, and id pairs by document counts."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelore.llm.common import written

#: Bytes and texts of a block at most (a longer text is a block of its own), and pieces that a worker remembers.
BLOCK_BYTES, BLOCK_TEXTS, REMEMBERED = 8 << 20, 8_192, 500_000
#: Pairs of one group that are written out one by one; larger groups are counted by id.
OUTER = 100_000
#: A blank between letters: tokens of neither side cross it, and each side begins anew there.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Low half of a pair's code.
SIDE = 32
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Pieces:
    """What is known of pieces: numbers of tokens, groups and links, the groups as text, and the linked id pairs with their numbers."""

    def __init__(self, numbers: np.ndarray, whole: np.ndarray, groups: list[bytes], at: np.ndarray, pairs: np.ndarray, times: np.ndarray):
        self.numbers, self.whole, self.groups, self.at, self.pairs, self.times = numbers, whole, groups, at, pairs, times

    @staticmethod
    def joined(parts: list[Pieces]) -> Pieces:
        sizes = np.cumsum([0, *(len(p.pairs) for p in parts)])
        at = np.concatenate([p.at[:-1] + n for p, n in zip(parts, sizes, strict=False)] + [sizes[-1:]])
        arrays = [np.concatenate([getattr(p, name) for p in parts]) for name in ("numbers", "whole", "pairs", "times")]
        return Pieces(arrays[0], arrays[1], list(chain.from_iterable(p.groups for p in parts)), at, arrays[2], arrays[3])


class Aligner:
    """Aligns byte-level tokens (A, by ranks) of blank + text with sentencepiece tokens (B) of text.

    Texts are cut at single blanks between letters. The pieces are aligned once each and remembered, up to REMEMBERED of
    them; then all are forgotten.
    """

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.a_sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.a_sizes[list(ranks.values())] = [len(x) for x in ranks]
        self.b_bytes = [self.token_bytes(i) for i in range(self.b.get_piece_size())]
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        self.numbers: dict[str, int] = {}
        self.known: Pieces | None = None

    def token_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def align(self, keys: list[str]) -> Pieces:
        """keys: texts without the blank before them; several only if none is empty or has a blank or white space at its ends.

        They are encoded together, joined by blanks, and by halves where a token isn't its own bytes.
        """
        together = " " + " ".join(keys)
        own = together.encode()
        a, b = self.a.encode_to_numpy(together).astype(np.int64), np.array(self.b.encode(together[1:]), dtype=np.int64)
        whole = np.ones(len(keys), dtype=bool)
        same = b"".join(map(self.b_bytes.__getitem__, b.tolist())) == own
        if len(keys) > 1 and not same:
            return Pieces.joined([self.align(keys[: len(keys) // 2]), self.align(keys[len(keys) // 2 :])])
        if not same:
            whole[0], a, b = False, a[:0], b[:0]
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.append(np.flatnonzero(np.frombuffer(own, dtype=np.uint8) == ord(" "))[1:], len(own)) if len(keys) > 1 else np.array([len(own)])
        n_a, n_b = (np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (a_end, b_end))
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        in_a, in_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        piece_of = np.empty(len(cuts), dtype=np.int64)  # each group lies in one piece
        piece_of[a_group] = np.repeat(np.arange(len(keys)), n_a)
        n_groups = np.bincount(piece_of, minlength=len(keys))
        links = np.zeros(len(keys), dtype=np.int64)
        np.add.at(links, piece_of, in_a * in_b)
        pairs, times, owner = self.pairs(a, b, in_a, in_b, piece_of)
        at = np.searchsorted(owner, np.arange(len(keys) + 1))
        return Pieces(np.stack([n_a, n_b, n_groups, links], axis=1), whole, self.texts(a, b, in_a, in_b, n_groups), at, pairs, times)

    @staticmethod
    def pairs(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, piece_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs' codes, how often, and the piece; sorted by piece, each pair once in a piece."""
        a_at, b_at = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        size = in_a * in_b
        few = np.flatnonzero(size <= OUTER)
        group = np.repeat(few, size[few])
        nth = np.arange(len(group)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
        code = (a[a_at[group] + nth // in_b[group]] << SIDE) | b[b_at[group] + nth % in_b[group]]
        codes, times, owners = [code], [np.ones(len(code), dtype=np.int64)], [piece_of[group]]
        for g in np.flatnonzero(size > OUTER).tolist():
            (x, nx), (y, ny) = (np.unique(ids[at[g] : at[g] + n[g]], return_counts=True) for ids, at, n in ((a, a_at, in_a), (b, b_at, in_b)))
            codes.append(((x[:, None] << SIDE) | y[None, :]).ravel())
            times.append((nx[:, None] * ny[None, :]).ravel())
            owners.append(np.full(len(x) * len(y), piece_of[g]))
        code, time, owner = np.concatenate(codes), np.concatenate(times), np.concatenate(owners)
        order = np.lexsort((code, owner))
        code, time, owner = code[order], time[order], owner[order]
        new = np.ones(len(code), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        return code[begin], np.add.reduceat(time, begin) if len(begin) else time, owner[begin]

    @staticmethod
    def texts(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n_groups: np.ndarray) -> list[bytes]:
        """Each piece's groups as a1,a2|b1;a3|b2,b3."""
        a_at, b_at = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        groups = np.empty(len(in_a), dtype=object)
        one = (in_a == 1) & (in_b == 1)
        code, which = np.unique((a[a_at[one]] << SIDE) | b[b_at[one]], return_inverse=True)
        groups[one] = np.array([f"{c >> SIDE}|{c & ((1 << SIDE) - 1)}" for c in code.tolist()], dtype=object)[which]
        x, y = list(map(str, a.tolist())), list(map(str, b.tolist()))
        for g, i, n, j, m in zip(*(v.tolist() for v in (np.flatnonzero(~one), a_at[~one], in_a[~one], b_at[~one], in_b[~one])), strict=True):
            groups[g] = ",".join(x[i : i + n]) + "|" + ",".join(y[j : j + m])
        groups = groups.tolist()
        ends = np.cumsum(n_groups).tolist()
        return [";".join(groups[s:e]).encode() for s, e in zip([0, *ends], ends, strict=False)]

    def learn(self, keys: list[str], odd: bool) -> None:
        """Aligns the keys that aren't known; when too many are, all but these are forgotten. odd: some have to be aligned alone."""
        new = list(set(keys).difference(self.numbers))
        if self.known is not None and len(self.numbers) + len(new) > REMEMBERED:
            self.numbers, self.known, new = {}, None, list(set(keys))
        alone = [k for k in new if not k or " " in k or k[0].isspace() or k[-1].isspace()] if odd else []
        if alone:
            new = [*alone, *set(new).difference(alone)]
        parts = [] if self.known is None else [self.known]
        parts += [self.align([k]) for k in alone]
        size, part = 0, []
        for key in new[len(alone) :]:
            part.append(key)
            size += len(key)
            if size > 1 << 18:
                parts.append(self.align(part))
                size, part = 0, []
        if part:
            parts.append(self.align(part))
        if new:
            self.known = Pieces.joined(parts)
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
        """Of a block of texts: COUNTS of each, the sha256 of its groups (None without tokens), and the linked pairs: text, code, how often."""
        cut = [t.split(" ") if t else [] for t in texts]
        keys = list(chain.from_iterable(cut))
        odd = {k for k in set(keys) if not k or k[0].isspace() or k[-1].isspace()}
        if odd:  # white space next to a blank: such texts are cut only where letters stand on both sides
            cut = [parts if odd.isdisjoint(parts) else BETWEEN.split(t) for parts, t in zip(cut, texts, strict=True)]
            keys = list(chain.from_iterable(cut))
        self.learn(keys, bool(odd))
        sizes = np.array(list(map(len, cut)), dtype=np.int64)
        n = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        text = np.repeat(np.arange(len(texts)), sizes)
        counts = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
        if not len(n):
            none = np.zeros(0, dtype=np.int64)
            return counts, [None] * len(texts), none, none, none
        known = self.known
        good = sizes > 0
        good[text[~known.whole[n]]] = False
        begins = np.cumsum(sizes) - sizes
        counts[sizes > 0] = np.add.reduceat(known.numbers[n], begins[sizes > 0], axis=0)
        counts[~good] = 0
        groups, hashes = known.groups, []
        ends = (begins + sizes).tolist()
        each = n.tolist()
        for i, ok in enumerate(good.tolist()):
            hashes.append(hashlib.sha256(b";".join([groups[k] for k in each[ends[i] - len(cut[i]) : ends[i]]])).digest() if ok else None)
        keep = good[text]
        code, time = np.unique(text[keep] * len(groups) + n[keep], return_counts=True)
        text, n = np.divmod(code, len(groups))
        many = known.at[n + 1] - known.at[n]
        place = np.repeat(known.at[n] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        text, pair, times = np.repeat(text, many), known.pairs[place], known.times[place] * np.repeat(time, many)
        return counts, hashes, text, pair, times


@lru_cache(maxsize=1)
def aligner(ranks_path: str, pattern: str, pieces_path: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(ranks_path, pattern, pieces_path)


def by_pair(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a block, where each one's texts begin in the others, and the texts with their sums of times; sorted by both."""
    order = np.lexsort((text, pair))
    text, pair, times = text[order], pair[order], times[order]
    new = np.ones(len(pair), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    times = np.add.reduceat(times, begin) if len(begin) else times
    text, pair = text[begin], pair[begin]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else begin
    return pair[first], first, text, times


def posts(text: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Texts (16 bits) with their multiplicities (16 bits, larger ones in several entries) as unsigned 32-bit numbers."""
    parts = -(-times // 0xFFFF)
    last = np.cumsum(parts) - 1
    each = np.full(parts.sum(), 0xFFFF, dtype=np.int64)
    each[last] = times - 0xFFFF * (parts - 1)
    return (np.repeat(text, parts) << 16 | each).astype("<u4")


def aligned_blocks(docs: DataFrame, make) -> DataFrame:
    """Rows of two kinds of every block of documents: the document's counts, or a pair with the documents of the block that link it."""
    names = ["block", "at", "doc_id", *COUNTS, "sha", "pair", "n_docs", "posts"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * 4, pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    schema = "block long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, sha binary, pair long, n_docs long, posts binary"

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, block = make(), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + BLOCK_TEXTS], dtype=np.int64), BLOCK_BYTES)))
                part = batch.slice(at, n)
                n = part.num_rows
                counts, hashes, text, pair, times = align(part.column(1).to_pylist())
                own = pa.array(np.full(n, block))
                yield rows({"block": own, "at": pa.array(np.arange(n, dtype=np.int32)), "doc_id": part.column(0), "sha": pa.array(hashes, pa.binary())} | {c: pa.array(counts[:, i]) for i, c in enumerate(COUNTS)}, n)
                pair, first, text, times = by_pair(text, pair, times)
                ends = np.append(first[1:], len(text)).astype(np.int64)
                for k in range(0, len(pair), 20_000):
                    few = slice(k, k + 20_000)
                    begin, end = first[few], ends[few]
                    linked, own_times = text[begin[0] : end[-1]], times[begin[0] : end[-1]]
                    cuts = np.concatenate([[0], np.cumsum(-(-own_times // 0xFFFF))])[np.append(begin, end[-1]) - begin[0]]
                    data = pa.py_buffer(posts(linked, own_times).tobytes())
                    lists = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((4 * cuts).astype(np.int32).tobytes()), data])
                    yield rows({"block": pa.array(np.full(len(begin), block)), "pair": pa.array(pair[few]), "n_docs": pa.array(end - begin), "posts": lists}, len(begin))
                at, block = at + n, block + 1

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, schema)


def align(docs: DataFrame, make) -> tuple[DataFrame, DataFrame]:
    """Alignment of two tokenizers over docs (doc_id, text): a row for each document, and one for each linked id pair.

    make gives the aligner in a worker. Documents: doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of token occurrences
    that share a group), n_best (links whose pair has the highest count of its A id, ties included), count_sum (counts of
    the pairs over the links), groups_sha256. Pairs: a, b, count (documents that hold it linked), best. A document without
    tokens (null or empty text, or one that a tokenizer doesn't give back byte by byte) has zeros and ''. Rows that repeat
    are documents each; null ids stay; further columns are ignored; no rows give no rows.

    Blocks of documents are aligned once and written: per pair the block's documents and multiplicities. Pairs' counts are
    sums over blocks, with partial sums. The postings meet them by a sort-merge join on the pair, whose sorted streams
    spill, and go back to their block, where each document's contributions are added up.
    """
    blocks = written(aligned_blocks(docs, make), "aligned-blocks")
    postings = blocks.where("pair is not null")
    counts = postings.groupBy("pair").agg(F.sum("n_docs").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", SIDE)))  # as many pairs as B has ids at most
    counts = written(counts.withColumn("best", F.col("count") == most), "pair-counts")
    met = postings.select(F.col("block").alias("home"), "pair", "posts").join(counts.hint("merge"), "pair").select("home", "posts", "count", "best")
    own = blocks.where("at is not null").select("block", "at", "doc_id", *COUNTS, "sha")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def contributions(documents: pa.Table, links: pa.Table) -> pa.Table:
        documents = documents.combine_chunks()
        at = documents["at"].to_numpy()
        n_best, count_sum = np.zeros(at.max(initial=-1) + 1, dtype=np.int64), np.zeros(at.max(initial=-1) + 1, dtype=np.int64)
        for batch in links.to_batches():
            lists = batch.column(1)
            sizes = pc.binary_length(lists).to_numpy() // 4
            entries = np.frombuffer(b"".join(lists.to_pylist()), dtype="<u4").astype(np.int64)
            document, times = entries >> 16, entries & 0xFFFF
            np.add.at(count_sum, document, times * np.repeat(batch.column(2).to_numpy(), sizes))
            np.add.at(n_best, document, times * np.repeat(batch.column(3).to_numpy(zero_copy_only=False), sizes))
        sha = pa.array([x.hex() if x else "" for x in documents["sha"].to_pylist()], pa.string())
        columns = {c: documents[c] for c in ("doc_id", *COUNTS)} | {"n_best": pa.array(n_best[at]), "count_sum": pa.array(count_sum[at]), "groups_sha256": sha}
        return pa.table(columns)

    found = own.groupBy("block").cogroup(met.groupBy("home")).applyInArrow(contributions, schema)
    pairs = counts.select(F.shiftright("pair", SIDE).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << SIDE) - 1)).cast("int").alias("b"), "count", "best")
    return found, pairs
