"""License scans: rolling word k-gram hashes vote for diagonals of license templates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases with their labels, and the usual notices of common licenses.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with this
        program. If not, see http://www.gnu.org/licenses/""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by/4.0/""",
}
#: Words of a k-gram; words by which neighbouring diagonals may differ; votes of a candidate; least share of a span's words
#: that equal the template's, and least equal words.
K, NEIGHBOURS, VOTES, SHARE, WORDS = 4, 3, 5, 0.8, 10
FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,share:double>>"

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PHRASES = {tuple(p.encode().split()): label for p, label in PHRASES.items()}


def words(text: bytes | None) -> list[bytes]:
    """Runs of a-z, digits and characters beyond ASCII, with A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def rolling(parts: list[bytes], k: int = K) -> np.ndarray:
    """The hash of every k consecutive words (signed longs): a polynomial in the words' crc32, modulo 2**64."""
    n = len(parts) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    each = np.fromiter(map(zlib.crc32, parts), dtype=np.uint64, count=len(parts))
    found = each[:n].copy()
    for i in range(1, k):
        found = found * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    return found.view(np.int64)


def template_words(templates: dict[str, str]) -> dict[str, list[bytes]]:
    return {label: words(text.encode()) for label, text in templates.items()}


def template_positions(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """h, label, at: the hashes of the templates' k-grams with their positions. As long as the templates given."""
    rows = [(int(h), label, at) for label, parts in template_words(templates).items() for at, h in enumerate(rolling(parts, k))]
    return spark.createDataFrame(rows, "h long, label string, at int")


def base(parts: list[bytes]) -> tuple[list[int], set[str], set[int]]:
    """Starts of all phrases, their labels, and the words that they cover."""
    starts, labels, covered = [], set(), set()
    joined = b" " + b" ".join(parts) + b" "
    for phrase, label in _PHRASES.items():
        if b" " + b" ".join(phrase) + b" " in joined:
            at = -1
            try:
                while True:
                    at = parts.index(phrase[0], at + 1)
                    if tuple(parts[at : at + len(phrase)]) == phrase:
                        starts.append(at)
                        labels.add(label)
                        covered.update(range(at, at + len(phrase)))
            except ValueError:
                pass
    return starts, labels, covered


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """The license phrases and notices in every row of docs (doc_id, text; further columns are ignored).

    All rolling hashes of k words of whole texts are joined to the templates' positions; hits vote for their diagonal
    (position in the text less position in the template), neighbouring diagonals merge, and a candidate is a span if its
    words, compared with the template's one by one along the merged diagonals, agree well enough; a span inside another
    one of its label is left out. Returns doc_id, n_words,
    n_base, first_word, last_word, base_labels, labels, score (share of the words in phrases or spans), spans. A null or
    wordless text has no words, null positions, empty labels and score 0. Rows that repeat are all returned.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    keys = [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text, "doc_id").alias("k2")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), *keys)
    targets = {label: parts for label, parts in template_words(templates).items()}
    known = np.unique(np.concatenate([rolling(p, k) for p in targets.values()]))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                each = [rolling(words(t.as_py()), k) for t in part.column(0)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), lists], names=["k1", "k2", "hashes"])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "k1", "k2", "n_words", "starts", "labels", "covered", "words"]
        for batch in batches:
            out = []
            for t in batch.column(1):
                parts = words(t.as_py())
                starts, labels, covered = base(parts)
                hit = np.isin(rolling(parts, k), known).any()
                out.append((len(parts), starts, sorted(labels), sorted(covered), b" ".join(parts) if hit else None))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], names=names)

    grams = rows.select("text", "k1", "k2").mapInArrow(hashes, "k1 long, k2 long, hashes array<long>")
    grams = grams.select("k1", "k2", F.posexplode("hashes").alias("pos", "h"))
    hits = grams.join(F.broadcast(template_positions(spark, templates, k)), "h")
    votes = hits.groupBy("k1", "k2", "label", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    order = Window.partitionBy("k1", "k2", "label").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS, F.lit(True)).cast("int")
    merged = votes.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    islands = merged.groupBy("k1", "k2", "label", "island").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high")
    )
    islands = islands.where(F.size("ats") >= VOTES).select("k1", "k2", F.struct("label", "low", "high", F.array_min("ats").alias("begin"), (F.array_max("ats") + k).alias("end")).alias("island"))
    candidates = islands.groupBy("k1", "k2").agg(F.collect_list("island").alias("islands"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))),
        ])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts, spans, covered = (r["words"] or b"").split(b" "), [], set(r["covered"])
                for x in r["islands"] or ():
                    target = targets[x["label"]]
                    equal = [
                        next((t + d for d in range(x["low"], x["high"] + 1) if 0 <= t + d < len(parts) and parts[t + d] == target[t]), None)
                        for t in range(x["begin"], x["end"])
                    ]
                    places = [p for p in equal if p is not None]
                    if len(places) >= max(WORDS, SHARE * len(equal)):
                        spans.append({"label": x["label"], "first_word": min(places), "last_word": max(places), "share": len(places) / len(equal)})
                        covered.update(range(min(places), max(places) + 1))
                inside = lambda a, b: a is not b and a["label"] == b["label"] and b["first_word"] <= a["first_word"] and a["last_word"] <= b["last_word"]
                spans = [a for i, a in enumerate(spans) if not any(inside(a, b) and (not inside(b, a) or j < i) for j, b in enumerate(spans))]
                labels = sorted({*r["labels"], *(s["label"] for s in spans)})
                spans.sort(key=lambda s: (s["first_word"], s["label"]))
                starts, n = r["starts"], r["n_words"]
                score = len(covered) / n if n else 0.0
                out.append((r["doc_id"], n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(r["labels"]), ",".join(labels), score, spans))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    read = rows.mapInArrow(phrases, "doc_id long, k1 long, k2 long, n_words long, starts array<long>, labels array<string>, covered array<long>, words binary")
    return read.join(candidates, ["k1", "k2"], "left").drop("k1", "k2").mapInArrow(verify, FOUND)


def plain(text: str | None) -> tuple[int, list[int], list[str]]:
    """Words, starts and base labels of a text, by a regular expression; for tests."""
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(parts)) if parts[i : i + len(p.split())] == p.split()]
    return len(parts), sorted(i for i, _ in found), sorted({label for _, label in found})
