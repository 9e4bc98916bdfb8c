"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both its sides."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelore.llm.common import fresh_path, written
from pricelore.llm.licenses import words

#: Classes that the network predicts: the commonest words have one each, all others share classes of words of like frequency.
OWN, SHARED = 192, 64
CLASSES = OWN + SHARED
#: Words that every task holds; the counts of all rarer ones, which share the last class, stay in a table and are joined.
KNOWN = 50_000
#: Tokens seen on each side, size of the hidden layer, and rounds of training, in which the positions take turns.
SIDE, HIDDEN, ROUNDS = 2, 16, 2
BATCH, RATE = 2_048, 0.5
#: Rows whose logits are held at once.
AT_ONCE = 256
#: Different words that a task counts before it passes them on.
COUNTED = 300_000


@dataclass
class Vocabulary:
    """Word to row; for each row its class and the log of its share of the class. The last row stands for a rare word that
    occurs once or never; `rare` is the path of the table (word, n) of those that occur more often."""

    rows: dict[bytes, int]
    classes: np.ndarray
    shares: np.ndarray
    frequency: np.ndarray
    rare: str
    network: list[np.ndarray] = field(default_factory=list)


class Rows(dict):
    """A vocabulary's rows; rare words get the last one."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.rows)
        self.rare = len(vocabulary.classes) - 1

    def __missing__(self, word: bytes) -> int:
        return self.rare

    def of(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), dtype=np.int32, count=len(parts))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n: counts of all words of all whole texts; tasks count before they pass on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words(text.as_py()))
                if len(counts) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts all words; gathers the KNOWN commonest and the sum over the others, whose counts are written.

    Words after the first OWN are cut by frequency into SHARED - 1 classes of about equal counts; the rare ones are the last class.
    """
    counts = written(word_counts(docs), "lm-words")
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN)
    known = [(bytes(r.word), r.n) for r in top.collect()]
    last = known[-1] if known else (b"", 0)
    rare = counts.where((F.col("n") < last[1]) | ((F.col("n") == last[1]) & (F.col("word") > F.lit(bytearray(last[0])))))
    n_rare = rare.agg(F.sum("n")).first()[0] or 0
    path = fresh_path(docs.sparkSession, "lm-rare")
    rare.where("n > 1").write.parquet(path)
    n = np.array([n for _, n in known] + [n_rare + 1], dtype=np.float64)  # one more: words that were never counted
    classes = np.arange(len(n))
    if len(known) > OWN:
        shared = n[OWN:-1]
        before = np.cumsum(shared) - shared
        classes[OWN:-1] = OWN + (before * (SHARED - 1) / shared.sum()).astype(np.int64)
    classes[-1] = CLASSES - 1
    whole = np.bincount(classes, n, minlength=CLASSES)
    shares = np.log(n / whole[classes])
    shares[-1] = -np.log(whole[-1])
    return Vocabulary({w: i for i, (w, _) in enumerate(known)}, classes.astype(np.int32), shares.astype(np.float32), np.log((whole + 1) / (whole + 1).sum()), path)


def fresh_network(frequency: np.ndarray) -> list[np.ndarray]:
    """Embeddings of each place's class (one more stands for no token), output weights and biases."""
    rng = np.random.default_rng(0)
    places = [rng.normal(0, 0.1, (CLASSES + 1, HIDDEN)) for _ in range(2 * SIDE)]
    return [x.astype(np.float32) for x in (*places, rng.normal(0, 0.1, (CLASSES, HIDDEN)), frequency)]


def contexts(classes: np.ndarray) -> np.ndarray:
    """For each token the classes of the SIDE tokens on its left and right."""
    padded = np.concatenate([np.full(SIDE, CLASSES, classes.dtype), classes, np.full(SIDE, CLASSES, classes.dtype)])
    n = len(classes)
    return np.stack([padded[i : i + n] for i in (*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1))], axis=1)


def hidden_values(network: list[np.ndarray], context: np.ndarray) -> np.ndarray:
    """Of each row, with a one after them for the biases."""
    found = np.ones((len(context), HIDDEN + 1), dtype=np.float32)
    hidden = network[0].take(context[:, 0], axis=0)
    for i in range(1, 2 * SIDE):
        hidden += network[i].take(context[:, i], axis=0)
    np.tanh(hidden, out=found[:, :HIDDEN])
    return found


def output_weights(network: list[np.ndarray]) -> tuple[np.ndarray, bool]:
    """Of each class, with its bias (less the largest one) last; whether logits may be too large for exp in single precision."""
    weights = np.concatenate([network[-2], (network[-1] - network[-1].max())[:, None]], axis=1)
    return weights, bool(np.abs(network[-2]).sum(axis=1).max() > 80)


def forward(network: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden values, and log-probabilities of all classes."""
    hidden = hidden_values(network, context)
    z = hidden @ output_weights(network)[0].T
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return hidden[:, :HIDDEN], z


def own_log_probability(network: list[np.ndarray], context: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of each token's own class; rows go AT_ONCE, so that their logits stay in the processor's cache."""
    (weights, large), found, ones = output_weights(network), np.empty(len(own), dtype=np.float64), np.ones(CLASSES, dtype=np.float32)
    for at in range(0, len(own), AT_ONCE):
        part = own[at : at + AT_ONCE]
        z = hidden_values(network, context[at : at + AT_ONCE]) @ weights.T
        if large:
            z -= z.max(axis=1, keepdims=True)
        mine = z[np.arange(len(part)), part]
        found[at : at + AT_ONCE] = mine - np.log(np.exp(z, out=z) @ ones)
    return found


def learn(network: list[np.ndarray], context: np.ndarray, target: np.ndarray) -> None:
    """One step of gradient descent over all rows given, in place; their gradients are summed up over AT_ONCE rows each."""
    (weights, large), n, ones = output_weights(network), len(target), np.ones(CLASSES, dtype=np.float32)
    step, back = np.zeros_like(weights), np.empty((n, HIDDEN), dtype=np.float32)
    for at in range(0, n, AT_ONCE):
        own = target[at : at + AT_ONCE]
        hidden = hidden_values(network, context[at : at + AT_ONCE])
        slope = hidden @ weights.T
        if large:
            slope -= slope.max(axis=1, keepdims=True)
        np.exp(slope, out=slope)
        slope *= (np.float32(RATE / n) / (slope @ ones))[:, None]
        slope[np.arange(len(own)), own] -= np.float32(RATE / n)
        back[at : at + AT_ONCE] = (slope @ network[-2]) * (1 - hidden[:, :HIDDEN] ** 2)
        step += slope.T @ hidden
    network[-2] -= step[:, :HIDDEN]
    network[-1] -= step[:, HIDDEN]
    places = np.arange(HIDDEN)
    for i in range(2 * SIDE):
        at = (context[:, i, None] * HIDDEN + places).ravel()
        network[i] -= np.bincount(at, back.ravel(), minlength=network[i].size).reshape(-1, HIDDEN).astype(np.float32) * 4


@lru_cache(maxsize=2)
def rows_of(shared) -> Rows:
    return Rows(shared.value)


def train(docs: DataFrame, vocab: Vocabulary) -> None:
    """Fits vocab.network on every token of all documents.

    The tokens' classes are written once, a byte each. A round trains on every ROUNDS-th position of each text, from a hash
    of the text on; the next round on the next ones. In each round every task goes on from the round's network over its
    partition, and the results are averaged, weighted by tokens: a sum over rows of the parameters, of which as many come
    back as the network has, whatever the input.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    known = spark.sparkContext.broadcast(vocab)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, classes = rows_of(known), known.value.classes.astype(np.uint8)
        for batch in batches:
            hashes, codes = [], []
            for text in (x.as_py() or b"" for x in batch.column(0)):
                hashes.append(zlib.crc32(text))
                codes.append(classes[rows.of(words(text))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(codes, pa.binary())], names=["hash", "codes"])

    texts = written(texts.mapInArrow(coded, "hash long, codes binary"), "lm-codes")  # a byte for each token
    vocab.network = fresh_network(vocab.frequency)
    sizes = [x.size // HIDDEN for x in vocab.network]
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(vocab.network)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            network, n = [x.copy() for x in shared.value], 0
            held: list[tuple[np.ndarray, np.ndarray]] = []
            n_held = 0
            for batch in batches:
                for code, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    c = np.frombuffer(codes.as_buffer(), dtype=np.uint8).astype(np.int32)
                    if not len(c):
                        continue
                    at = np.arange((turn + code) % ROUNDS, len(c), ROUNDS)
                    held.append((contexts(c)[at], c[at]))
                    n_held += len(at)
                    if n_held >= BATCH:
                        context, target = (np.concatenate(x) for x in zip(*held, strict=True))
                        whole = len(target) // BATCH * BATCH
                        for i in range(0, whole, BATCH):
                            learn(network, context[i : i + BATCH], target[i : i + BATCH])
                        n += whole
                        held, n_held = [(context[whole:], target[whole:])], len(target) - whole
            if n_held:
                context, target = (np.concatenate(x) for x in zip(*held, strict=True))
                learn(network, context, target)
                n += n_held
            if n:
                table = np.concatenate([x.reshape(-1, HIDDEN) for x in network]).astype(np.float64) * n
                columns = [pa.array(np.arange(len(table))), pa.array(np.full(len(table), n)), *(pa.array(np.ascontiguousarray(table[:, j])) for j in range(HIDDEN))]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "n", *(f"x{j}" for j in range(HIDDEN))])

        schema = "at long, n long, " + ", ".join(f"x{j} double" for j in range(HIDDEN))
        sums = texts.mapInArrow(run, schema).groupBy("at").agg(*(F.sum(f"x{j}") / F.sum("n") for j in range(HIDDEN))).collect()
        if not sums:
            return
        table = np.array([r[1:] for r in sorted(sums)], dtype=np.float32)
        parts = np.split(table, np.cumsum(sizes)[:-1])
        vocab.network = [p.reshape(x.shape) for p, x in zip(parts, vocab.network, strict=True)]


def log_probabilities(vocab: Vocabulary, rows: Rows, parts: list[bytes]) -> np.ndarray:
    """Of every token given its neighbours: its class by the network, times its share of the class. Rare words count as occurring once."""
    if not parts:
        return np.zeros(0)
    row = np.fromiter(map(rows.__getitem__, parts), dtype=np.int64, count=len(parts))
    c = vocab.classes[row]
    return vocab.shares[row] + own_log_probability(vocab.network, contexts(c), c)


def score(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood (natural log, summed over all tokens), mean_log_probability.

    docs: doc_id, text; further columns are ignored. Null and wordless texts have no tokens, the sum 0 and a null mean. Rows
    that repeat are scored each. The rare words' counts are joined and the logs added to the rows' sums.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, v = rows_of(shared), shared.value
        row = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int32())]))
        for whole in batches:
            for begin in range(0, whole.num_rows, 200):
                batch, each, rare = whole.slice(begin, 200), [], []
                for text in batch.column(1):
                    parts = words(text.as_py())
                    own = rows.of(parts)
                    seldom = Counter(map(parts.__getitem__, np.flatnonzero(own == rows.rare).tolist()))
                    each.append(own)
                    rare.append([{"word": w, "k": k} for w, k in seldom.items()])
                n, at = np.array([len(x) for x in each], dtype=np.int64), pa.array(np.arange(row, row + len(each)))
                row += len(each)
                yield pa.RecordBatch.from_arrays([at, batch.column(0), pa.array(n), pa.array(sums(v, each)), pa.array(rare, kind)], names=["row", "doc_id", "n_tokens", "once", "rare"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = written(texts.mapInArrow(run, "row long, doc_id long, n_tokens long, once double, rare array<struct<word:binary,k:int>>"), "lm-scores")
    counts = docs.sparkSession.read.schema("word binary, n long").parquet(vocab.rare)
    more = found.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k").join(counts, "word")
    more = more.groupBy("row").agg(F.sum(F.col("k") * F.log("n")).alias("more"))
    whole = F.col("once") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens"))
    return found.drop("rare").join(more, "row", "left").select("doc_id", "n_tokens", whole.alias("pseudo_log_likelihood"), mean.alias("mean_log_probability"))


def sums(vocab: Vocabulary, each: list[np.ndarray]) -> np.ndarray:
    """Sums of log-probabilities of texts, given as their words' rows."""
    none = np.full(SIDE, -1, dtype=np.int32)
    row = np.concatenate([none, *(x for own in each for x in (own, none))])  # what is beside a text is none of its neighbours
    c = np.where(row >= 0, vocab.classes[row], CLASSES)
    at = np.flatnonzero(row >= 0)
    found = np.empty(len(at), dtype=np.float64)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        context = c[part[:, None] + np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])]
        found[i : i + (1 << 16)] = vocab.shares[row[part]] + own_log_probability(vocab.network, context, c[part])
    return np.bincount(np.repeat(np.arange(len(each)), [len(x) for x in each]), found, minlength=len(each))


def model(docs: DataFrame) -> Vocabulary:
    """A vocabulary with a trained network."""
    vocab = vocabulary(docs)
    train(docs, vocab)
    return vocab
