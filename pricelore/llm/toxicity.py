"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted on at most: so many of each label, chosen by a hash of their ids, whatever
#: their length.
TRAIN_TOXIC, TRAIN_CLEAN = 2_000, 4_000
FEATURES = 1 << 18
#: Words whose weights a Python worker remembers.
REMEMBERED = 500_000
SCHEMA = "doc_id long, score double, n_sentences int, offending array<struct<sentence:int,probability:double,text:string>>"
#: Punctuation is a blank inside words' sentences; each of . ! ? and the line end ends a sentence.
TABLE = bytes(0x20 if chr(b) in "\t\r\x0b\x0c\"#$%&'()*+,-/:;<=>@[\\]^_`{|}~" else 0x2E if chr(b) in "!?\n" else b for b in range(256))
ENDS = re.compile(r"[.!?\n]")


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself, its beginnings, and beginnings with the word's length."""
    w = word.decode("utf-8", "replace")
    n = min(len(w), 15)
    parts = [f"w{w}"] + [f"{k}{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k] + [f"l{n}{w[:k]}" for k in (3, 4, 5) if len(w) >= k]
    return [zlib.crc32(p.encode()) % FEATURES for p in parts]


def sentences(text: str) -> list[bytes]:
    return text.lower().encode().translate(TABLE).split(b".")


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class WordWeights(dict):
    """Weight of a word: the sum of its features' weights, remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        value = float(self.model.weights[features(word)].sum())
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def fit(texts: list[str], labels: list[int], epochs: int = 80, rate: float = 0.1, sparsity: float = 1e-4, least_docs: int = 5) -> Model:
    """Logistic sentence scores whose noisy-or, 1 - prod(1 - p), fits the documents' labels.

    Adam over all documents at once, with an L1 penalty by soft thresholds; features of fewer than least_docs documents
    are left out.
    """
    known: dict[bytes, int] = {}
    word_of, sentence_of, doc_of = array("i"), array("i"), array("i")
    for doc, text in enumerate(texts):
        for part in sentences(text or ""):
            if words := part.split():
                word_of.extend(known.setdefault(w, len(known)) for w in words)
                sentence_of.extend([len(doc_of)] * len(words))
                doc_of.append(doc)
    none = Model(np.zeros(FEATURES, dtype=np.float32), -20.0)
    if not doc_of or not any(labels):
        return none
    words, sentence, doc = (np.frombuffer(x, dtype=np.int32) for x in (word_of, sentence_of, doc_of))
    flat, each = array("i"), array("i")
    for w in known:
        found = features(w)
        flat.extend(found)
        each.append(len(found))
    n_words, sizes, feature = len(known), np.frombuffer(each, dtype=np.int32), np.frombuffer(flat, dtype=np.int32)
    owner = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
    del known
    first, in_docs = np.cumsum(sizes) - sizes, np.zeros(FEATURES, dtype=np.int64)
    ends = np.searchsorted(doc[sentence], np.arange(len(texts) + 1))
    for i in range(len(texts)):
        own = np.unique(words[ends[i] : ends[i + 1]])
        many = sizes[own]
        at = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        in_docs[np.unique(feature[at])] += 1
    keep = in_docs[feature] >= least_docs
    owner, feature = owner[keep], feature[keep]
    if not len(feature):
        return none
    used, feature = np.unique(feature, return_inverse=True)
    y = np.array(labels, dtype=bool)
    w, b = np.zeros(len(used)), -5.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, epochs + 1):
        by_word = np.bincount(owner, w[feature], minlength=n_words)
        z = np.bincount(sentence, by_word[words], minlength=len(doc)) + b
        hazard = np.bincount(doc, np.logaddexp(0, z), minlength=len(y))
        slope = np.where(y, -1 / np.expm1(np.clip(hazard, 1e-6, 50)), 1.0) / len(y)
        by_sentence = slope[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        back = np.bincount(words, by_sentence[sentence], minlength=n_words)
        grad = np.append(np.bincount(feature, back[owner], minlength=len(used)), by_sentence.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        size = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        move = size * m / (1 - 0.9**step)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - sparsity * size[:-1], 0)
    weights = np.zeros(FEATURES, dtype=np.float32)
    weights[used] = w
    return Model(weights, float(b))


def held_out():
    """Whether a document is kept from learning: the crc32 of its id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Model:
    """A model from at most `toxic` and `clean` labelled documents outside of the held-out ids, by their whole texts.

    Of a document with several labels the highest counts; labels without an id or value, and ids without a text in docs,
    are left out. Of rows with one id, the smallest text counts. The documents are drawn by a hash of their ids.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    there = known.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = there.where("toxic = 1").orderBy(order, "doc_id").limit(toxic).unionByName(there.where("toxic = 0").orderBy(order, "doc_id").limit(clean))
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # toxic + clean rows at most
    fitted = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(order, "doc_id").select("text", "toxic")
    found = [(r.text, r.toxic) for r in fitted.toLocalIterator()]
    return fit([t for t, _ in found], [y for _, y in found])


@lru_cache(maxsize=2)
def remembered(shared) -> WordWeights:
    return WordWeights(shared.value)


def logits(known: WordWeights, text: str | None) -> np.ndarray:
    """Of every sentence; minus infinity for one without words."""
    get = known.__getitem__
    return np.array([sum(map(get, w)) if (w := s.split()) else -np.inf for s in sentences(text or "")]) + known.model.bias


def noisy_or(z: np.ndarray) -> float:
    """1 - prod(1 - p) over sentences of the given logits; 0 without any."""
    return float(-np.expm1(-np.logaddexp(0, z[z > -np.inf]).sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_sentences and the offending sentences (probability 0.5 or more) of every row of docs (doc_id, text).

    Whole texts are scored. Null and wordless texts have score 0. Rows that repeat an id are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(shared)
        kind = pa.list_(pa.struct([("sentence", pa.int32()), ("probability", pa.float64()), ("text", pa.string())]))
        for batch in batches:
            scores, counts, offending = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                z = logits(known, text)
                counts.append(int((z > -np.inf).sum()))
                scores.append(noisy_or(z))
                bad = np.flatnonzero(z >= 0).tolist()
                parts = ENDS.split(text) if bad else []
                offending.append([{"sentence": i, "probability": float(1 / (1 + np.exp(-z[i]))), "text": parts[i]} for i in bad])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(offending, kind)], names=["doc_id", "score", "n_sentences", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of docs that score below `most`, with all their columns.

    docs: text and any further columns. Null and wordless texts score 0 and stay; rows that repeat are judged alike; no
    rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts):
        import pandas as pd

        known = remembered(shared)
        return pd.Series([noisy_or(logits(known, text)) for text in texts], dtype="float64")

    return docs.where(toxic(F.col("text").cast("string")) < most)
